"""The asset store of sites: discovered URLs, page snapshots, cached discoveries and audit results.

Each change rewrites the buckets that it concerns (bucket_store).  Deletes leave a
tombstone, so that a write that is older but arrives later does not bring a row back;
results expire by their time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators import store
from pagelens.operators.bucket_store import BucketStore, Commit
from pagelens.operators.shared import cut

URLS = "site_id string, url_hash string, final_url string, url_type string, discovery_source string, priority int, fetch_status string, fetched_at timestamp, is_active boolean"
SNAPSHOTS = "site_id string, url_hash string, normalized_url string, final_url string, url_type string, profile_json string, content_hash string, fetched_at timestamp, gone boolean"
SITES = "site_id string, discovery_json string, profiled_page_count int, total_url_count int, snapshot_url_count int, last_discovered_at timestamp, last_snapshot_at timestamp"
RESULTS = "cache_key string, payload string, saved_at timestamp, expires_at timestamp"

CACHED_NOTE = "Loaded discovery and page profiles from stored assets."


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its types; those that rows lack are null."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _latest(keys: list[str], *order: str):
    return lambda old, batch: store.last_write(old.unionByName(batch), keys, *order).select(batch.columns)


class AssetStore(BucketStore):
    # -- URLs --------------------------------------------------------------------------

    def upsert_urls(self, batch: DataFrame) -> Commit:
        """batch: URLS without is_active, and ord, the order of rows of one key; see store.upsert_urls for what wins."""

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            old = _typed(old, URLS)
            return _typed(store.upsert_urls(old, new), URLS)

        given = batch.select(*[F.col(f.strip().split(" ")[0]).cast(f.strip().split(" ")[1]) for f in URLS.split(",") if "is_active" not in f], "ord")
        given = given.withColumn("fetch_status", F.coalesce(F.nullif(F.col("fetch_status"), F.lit("")), F.when(F.col("fetched_at").isNotNull(), "success").otherwise("pending")))
        return self.merge("urls", given, "site_id", ["url_hash"], rule)

    def urls(self, sites: DataFrame | None = None) -> DataFrame:
        """Active URLs, of the given sites only if there are any; order them by priority and hash."""
        return self._of("urls", URLS, sites).where("is_active")

    def _of(self, table: str, schema: str, sites: DataFrame | None) -> DataFrame:
        rows = self.read(table, None if sites is None else self.buckets_of_sites(sites))
        rows = self.spark.createDataFrame([], schema) if rows is None else rows
        return rows if sites is None else rows.join(sites.select("site_id").distinct(), "site_id", "left_semi")

    # -- snapshots ----------------------------------------------------------------------

    def save_snapshots(self, batch: DataFrame) -> Commit:
        """batch: SNAPSHOTS without gone; the latest fetch of each URL stays, a delete of the same moment beats it."""
        given = _typed(batch.withColumn("gone", F.lit(False)), SNAPSHOTS)
        return self.merge("snapshots", given, "site_id", ["url_hash"], _latest(["site_id", "url_hash"], "fetched_at", "gone", "content_hash"))

    def snapshots(self, sites: DataFrame | None = None) -> DataFrame:
        return self._of("snapshots", SNAPSHOTS, sites).where("not gone").drop("gone")

    def snapshot_map(self, sites: DataFrame | None = None) -> DataFrame:
        """Each snapshot under its normalised and its final URL, per site; the later one under a URL counts."""
        each = self.snapshots(sites).select(F.explode(F.array_distinct(F.array("normalized_url", "final_url"))).alias("lookup_url"), "*").where("lookup_url is not null")
        return store.last_write(each, ["site_id", "lookup_url"], "fetched_at", "url_hash")

    def clear_sites(self, sites: DataFrame, at: Column) -> Commit:
        """Delete the sites' snapshots, mark their URLs stale, forget their discoveries, in one commit.

        Rows of other sites in the same buckets are written as they are.  Snapshots that are later than `at` stay.
        """
        sites = cut(sites.select("site_id").where("site_id is not null").distinct().withColumn("_hit", F.lit(True)))
        base, touched = self.manifest(), self.buckets_of_sites(sites)

        def changed(table: str, schema: str, values: dict[str, Column], only: Column | None = None) -> tuple[DataFrame, Column, list[int]]:
            rows = self.read(table, touched, base)
            rows = self.spark.createDataFrame([], schema) if rows is None else rows
            joined = rows.join(sites, "site_id", "left")
            hit = F.col("_hit").isNotNull() if only is None else F.col("_hit").isNotNull() & only
            joined = joined.withColumn("_hit", hit)
            out = joined.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else c for c in rows.columns])
            return _typed(out, schema), self.bucket(F.col("site_id"), F.struct("url_hash") if "url_hash" in rows.columns else F.struct("site_id")), touched

        null = F.lit(None)
        older = (F.col("fetched_at") <= at) & ~F.col("gone")
        gone = {c: null for c in ("profile_json", "content_hash", "normalized_url", "final_url", "url_type")} | {"fetched_at": at, "gone": F.lit(True)}
        return self.commit(base, {
            "snapshots": changed("snapshots", SNAPSHOTS, gone, older),
            "urls": changed("urls", URLS, {"fetch_status": F.lit("stale"), "fetched_at": null}),
            "sites": changed("sites", SITES, {"discovery_json": null, "profiled_page_count": null, "snapshot_url_count": F.lit(0), "last_snapshot_at": null}),
        })

    def purge(self, before: Column) -> Commit | None:
        """Drop tombstones older than a moment, when no write that old can still come; None if there are none."""
        base, old = self.manifest(), (F.col("gone") & (F.col("fetched_at") < before))
        rows = self.read("snapshots", None, base)
        bucket = self.bucket(F.col("site_id"), F.struct("url_hash"))
        touched = [] if rows is None else sorted(r.b for r in rows.where(old).select(bucket.alias("b")).distinct().collect())
        return self.commit(base, {"snapshots": (self.read("snapshots", touched, base).where(~old), bucket, touched)}) if touched else None

    # -- discoveries ------------------------------------------------------------------------

    def save_discoveries(self, batch: DataFrame) -> Commit:
        """batch: SITES; the latest discovery of each site stays."""
        return self.merge("sites", _typed(batch, SITES), "site_id", ["site_id"], _latest(["site_id"], "last_discovered_at", "discovery_json"))

    def cached_discoveries(self, requests: DataFrame) -> DataFrame:
        """requests (site_id, full_audit, max_pages) with the discovery that serves each, if any.

        A full audit wants as many profiled pages as it may visit.  inventory_satisfied tells whether as many URLs are known.
        """
        found = self.lookup("sites", requests, "site_id", ["site_id"])
        found = self.spark.createDataFrame([], SITES) if found is None else found
        joined = requests.join(found, "site_id", "left")
        stored = F.nullif(F.col("discovery_json"), F.lit(""))
        enough = ~F.col("full_audit") | (F.coalesce("profiled_page_count", F.lit(0)) >= F.col("max_pages"))
        served = stored.isNotNull() & enough
        when = lambda value: F.when(served, value)
        return joined.select(
            *requests.columns, served.alias("reused_discovery"), when(stored).alias("discovery_json"), when(F.col("profiled_page_count")).alias("reused_snapshot_count"),
            when(F.coalesce("total_url_count", F.lit(0)) >= F.col("max_pages")).alias("inventory_satisfied"), when(F.lit(CACHED_NOTE)).alias("note"),
        )

    # -- results of audits --------------------------------------------------------------------

    def put_results(self, batch: DataFrame, days: int = 7) -> Commit:
        """batch (cache_key, payload, saved_at); each expires after so many days.  Rewritten buckets lose what had expired by the batch's first row."""
        given = _typed(batch.withColumn("expires_at", F.col("saved_at") + F.make_dt_interval(F.lit(days))), RESULTS)

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            first = new.agg(F.min("saved_at").alias("_first"))
            young = old.join(F.broadcast(first), F.col("expires_at") > F.col("_first")).drop("_first")
            return _latest(["cache_key"], "saved_at", "payload")(young.select(new.columns), new)

        return self.merge("results", given, "cache_key", ["cache_key"], rule)

    def get_results(self, wanted: DataFrame, now: Column) -> DataFrame:
        """wanted (cache_key) -> those of them that are stored and have not expired; reads their buckets only."""
        found = self.lookup("results", wanted, "cache_key", ["cache_key"])
        return self.spark.createDataFrame([], RESULTS) if found is None else found.where(F.col("expires_at") > now)
