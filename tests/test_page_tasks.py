"""How pages are dealt over tasks, and how often a query parses them."""

import pytest
from pyspark.sql import functions as F

from pagelens.plans.queries import QUERIES
from pagelens.sources import pages as P


def test_tasks_grow_with_the_table_and_hold_like_shares(spark, tmp_path, monkeypatch):
    spark.range(4000).select(F.col("id").alias("page_id"), F.lit("https://h.example/").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("html")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(P, "PAGES_SHARE", 8 << 10)
    pages = P.read_pages(spark, str(tmp_path))
    counts = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert pages.rdd.getNumPartitions() == len(counts) > 2 * spark.sparkContext.defaultParallelism
    assert sum(counts) == 4000 and max(counts) < 4 * 4000 / len(counts)


@pytest.mark.parametrize("name", ["seo_cards", "site_reports", "structure_graph_documents", "structure_graph_edge_attributes", "structure_graph_entity_attributes", "structure_graph_read"])
def test_what_is_read_several_times_is_parsed_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "<!--" not in plan  # the patterns of the parser lie behind the cut
