"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which driver and executors see, as a URI.

    It is the session's ``spark.checkpoint.dir``; only a local session that names none
    gets a folder of its own, since executors elsewhere could not read one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("checkpoint"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_key(text: str = "text") -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes_total(docs: DataFrame) -> int:
    """Bytes of all texts, by which sketches and partitions are sized."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


#: Rows of one key that a task may get; keys with more are spread over several.
HOT = 512
#: Keys that are spread at most; the ones with most rows come first.
MOST_HOT = 100_000


def hot_keys(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """sizes (keys, n), a row a key -> keys and _parts, into how many parts to deal the keys with more than HOT rows; the MOST_HOT with most rows."""
    # a row of one part that changes nothing: the plan is the same whether or not a key is hot; it stands for a key like it
    nothing = [F.lit(0).cast(sizes.schema[k].dataType) for k in keys]
    other = reduce(Column.__or__, [F.col(k) != x for k, x in zip(keys, nothing)])
    hot = sizes.where((F.col("n") > HOT) & other).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("_parts"))
    none = sizes.sparkSession.range(1).select(*[x.alias(k) for k, x in zip(keys, nothing)], F.lit(1).alias("_parts"))
    return hot.unionByName(none).orderBy(F.col("_parts").desc(), *keys).limit(MOST_HOT)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", deal: Column | None = None, hot: DataFrame | None = None) -> DataFrame:
    """left joined with right on keys; right has n, how many rows of left have its keys.

    Keys with more than HOT rows are dealt over n / HOT parts: left's rows by deal, or
    one by one, and right's rows copied to each part.  The list of such keys is
    broadcast; it has at most MOST_HOT rows, and what it leaves out is joined as any
    other key.  Without deal, left must be written (see cut), since its rows are dealt
    by their place.  hot is that list where it is written already; else right's plan is
    run twice, once for the list.
    """
    hot = hot_keys(right, keys) if hot is None else hot
    parts, deal = F.coalesce("_parts", F.lit(1)), F.monotonically_increasing_id() if deal is None else F.xxhash64(deal)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(deal, parts).cast("int")).drop("_parts")
    copied = right.drop("n").join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied.hint("merge"), [*keys, "_part"], how).drop("_part")
