"""The asset store as merges of tables: upserts, last writes, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

URL_KEYS = ["site_id", "url_hash"]


def fold_batch(batch: DataFrame) -> DataFrame:
    """Rows of one batch with one key, folded in their order (ord): later values win where they are known."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    first_type = F.min_by("url_type", F.when(~F.col("url_type").isin("unknown", "page"), F.col("ord")))
    fetched_or_first = F.coalesce(F.max_by("fetch_status", F.when(F.col("fetched_at").isNotNull(), F.col("ord"))), F.min_by("fetch_status", "ord"))
    return batch.groupBy(*URL_KEYS).agg(last("final_url"), F.coalesce(first_type, F.max_by("url_type", "ord")).alias("url_type"), last("discovery_source"), F.min("priority").alias("priority"), fetched_or_first.alias("fetch_status"), F.max("fetched_at").alias("fetched_at"))


def upsert_urls(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge a batch into the URL table: known values stay where the batch has none, a type is upgraded only from
    unknown or page, the priority falls to the lesser, the status changes only with a fetch, rows become active."""
    o, n = old.alias("o"), fold_batch(batch).alias("n")
    both = o.join(n, URL_KEYS, "full")
    new = F.col("n.priority").isNotNull()
    upgraded = F.when(F.col("o.url_type").isNull() | (F.col("o.url_type").isin("unknown", "page") & new), F.coalesce("n.url_type", "o.url_type")).otherwise(F.col("o.url_type"))
    status = F.when(F.col("n.fetched_at").isNotNull(), F.col("n.fetch_status")).otherwise(F.coalesce("o.fetch_status", "n.fetch_status"))
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return both.select(*URL_KEYS, pick("final_url"), upgraded.alias("url_type"), pick("discovery_source"), F.least("o.priority", "n.priority").alias("priority"), status.alias("fetch_status"), pick("fetched_at"), (new | F.coalesce("o.is_active", F.lit(False))).alias("is_active"))


def last_write(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row of each key; order: columns by which later is greater."""
    names = [c for c in rows.columns if c not in keys]
    latest = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in names])).alias("latest")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"latest._{c}").alias(c) for c in names])


def snapshot_by_url(snapshots: DataFrame) -> DataFrame:
    """Each snapshot under its final and its normalised URL; the later one under a URL counts."""
    each = snapshots.select(F.explode(F.array_distinct(F.array("normalized_url", "final_url"))).alias("lookup_url"), "*").where("lookup_url is not null")
    return last_write(each, ["lookup_url"], "fetched_at", "snapshot_id")


def reuse_snapshots(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """urls with the snapshot known for each; to_fetch where there is none."""
    found = snapshot_by_url(snapshots).withColumnRenamed("lookup_url", "url")
    return urls.join(found, "url", "left").withColumn("to_fetch", F.col("snapshot_id").isNull())


def ensure_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(old.columns))


def mark_stale(rows: DataFrame, site_ids: DataFrame) -> DataFrame:
    """fetch_status stale for the sites given."""
    hit = site_ids.select("site_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "site_id", "left").withColumn("fetch_status", F.when(F.col("_hit"), "stale").otherwise(F.col("fetch_status"))).drop("_hit")


def latest_graph(tasks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tasks (task_id, site_id) -> the task's latest snapshot, else the site's."""
    by = lambda key: last_write(snapshots, [key], "built_at", "snapshot_id").select(key, F.struct("snapshot_id", "built_at").alias(f"by_{key}"))
    joined = tasks.join(by("task_id"), "task_id", "left").join(by("site_id"), "site_id", "left")
    used = F.coalesce("by_task_id", "by_site_id")
    return joined.select("task_id", "site_id", used["snapshot_id"].alias("snapshot_id"), F.when(F.col("by_task_id").isNotNull(), "task").when(F.col("by_site_id").isNotNull(), "site").otherwise("none").alias("source"))


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
