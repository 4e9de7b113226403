"""The folder that driver and executors share, and lineage cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session that names none gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("checkpoint"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[str], start: int, name: str) -> tuple[DataFrame, int]:
    """rows with the numbers start + 1, start + 2, … in the given order, and the last number.

    The rows are sorted by ranges; the driver sees one count a range, so no task holds them all.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    firsts, last = [], start
    for r in sorted(ranged.groupBy("_range").count().collect()):
        firsts.append((r["_range"], last + 1))
        last += r["count"]
    firsts = rows.sparkSession.createDataFrame(firsts, "_range int, _first long")  # a row a range
    return ranged.join(F.broadcast(firsts), "_range").withColumn(name, F.col("_first") + F.col("_nth")).drop("_range", "_nth", "_first"), last
