"""Fetched pages as a stream: late duplicates drop out, each batch is merged into the buckets of a table that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators.bucket_store import BucketStore
from pagelens.operators.store import last_write


def page_stream(pages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """pages (url, html, fetched_at) as a stream -> url_hash, url, content_hash, fetched_at; a repeated fetch of the same content within the delay counts once."""
    keyed = pages.select(F.sha2(urls.normalize_url(F.col("url")), 256).alias("url_hash"), "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"), "fetched_at")
    return keyed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url_hash", "content_hash"])


def fetch_counts(pages: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Fetches per host and window of event time."""
    hosts = pages.withColumn("host", urls.host(urls.normalize_url(F.col("url"))))
    return hosts.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window), "host").agg(F.count("*").alias("fetches"))


def merge_into(folder: str, buckets: int = 64):
    """foreachBatch writer: the batch's latest row of each URL joins the table ``pages`` of a bucket store in folder.

    A batch rewrites the buckets that its URLs fall in and no other.  The store's manifest holds the number of the
    last batch, in the same commit as its rows, so a repeated batch changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = BucketStore(batch.sparkSession, folder, buckets)
        if store.manifest().counters.get("batch", -1) >= number:
            return
        latest = lambda old, new: last_write(old.unionByName(new), ["url_hash"], "fetched_at", "content_hash").select(new.columns)
        store.merge("pages", batch, "url_hash", ["url_hash"], latest, {"batch": number})

    return write


def merged_pages(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that merge_into writes, as of its last batch; None before the first."""
    return BucketStore(spark, folder).read("pages")
