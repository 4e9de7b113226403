"""Which stored graph answers for an audit task: its own latest snapshot, else its site's, each field else from the site's current graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.graph_store import NOT_BUILT_NOTE, OTHER_TASK_NOTE, REUSED_NOTE, REUSED_NOTE_NO_TASK, VERSION
from pagelens.operators.shared import numbered
from pagelens.operators.store import last_write

#: JSON fields of a snapshot's graph, and the counts of its summary.
FIELDS = ("entities", "edges", "evidence", "source_pages")
COUNTS = ("entity_count", "edge_count", "evidence_count", "source_snapshot_count")


def _latest(snapshots: DataFrame, key: str, prefix: str) -> DataFrame:
    """The latest snapshot of each key, as one struct."""
    given = snapshots.where((F.col("graph_version") == VERSION) & F.col(key).isNotNull())
    found = last_write(given, [key], "built_at", "graph_snapshot_id")
    return found.select(key, F.struct(*snapshots.columns).alias(prefix))


def _with_snapshot(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests (task_id, site_id, …) with by_task and by_site, the latest snapshots under either."""
    return requests.join(_latest(snapshots, "task_id", "by_task"), "task_id", "left").join(_latest(snapshots, "site_id", "by_site"), "site_id", "left")


def _empty(json: Column) -> Column:
    return json.isNull() | F.trim(json).isin("", "[]", "{}", "null")


def _some(*numbers: Column) -> Column:
    """The first that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(n.cast("long"), F.lit(0).cast("long")) for n in numbers], F.lit(0).cast("long"))


def task_graphs(requests: DataFrame, tasks: DataFrame, snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """requests (task_id) -> the graph that answers for each; tasks that neither are known nor have a snapshot give no row.

    tasks: task_id, site_id; snapshots: graph_snapshot_id, site_id, task_id, graph_version, note, built_at, COUNTS, the JSON
    texts FIELDS and summary_<count>, what the graph itself says of its counts; current: site_id, FIELDS, COUNTS, the site's graph as it
    is.  A snapshot without entities or edges, or that knows no evidence field, takes what it lacks from the
    current graph.  Joins by task and by site; the snapshots are reduced to one a key before.
    """
    asked = requests.select("task_id").where("task_id is not null").distinct()
    known = asked.join(tasks.select("task_id", "site_id", F.lit(True).alias("known")), "task_id", "left")
    found = _with_snapshot(known, snapshots).withColumnRenamed("site_id", "task_site")
    own = F.col("by_task").isNotNull()
    found = found.select("task_id", "task_site", "known", own.alias("exact_task_match"), F.coalesce("by_task", "by_site").alias("s")).where("known or s is not null")
    found = found.withColumn("site_id", F.coalesce("s.site_id", "task_site"))
    now = current.select(F.col("site_id"), F.struct(*FIELDS, *COUNTS).alias("c"))
    found = found.join(now, "site_id", "left")
    s, c = (lambda n: F.col(f"s.{n}")), (lambda n: F.col(f"c.{n}"))
    lacks = _empty(s("entities")) | _empty(s("edges")) | s("evidence").isNull()
    field = lambda n: F.when(~_empty(s(n)), s(n)).when(lacks & ~_empty(c(n)), c(n)).otherwise("[]").alias(n)
    count = lambda n: _some(F.coalesce(s(f"summary_{n}"), F.when(lacks, c(n))), s(n)).alias(n)
    built = F.col("s").isNotNull()
    other = ~F.col("exact_task_match") & (F.coalesce(s("task_id").cast("string"), F.lit("")) != "") & ~s("task_id").eqNullSafe(F.col("task_id"))
    note = F.when(~built, NOT_BUILT_NOTE).when(other, F.coalesce(F.nullif(s("note"), F.lit("")), F.lit(OTHER_TASK_NOTE))).otherwise(s("note"))
    return found.select(
        "task_id", s("task_id").alias("snapshot_task_id"), "exact_task_match", built.alias("built"), note.alias("note"), "site_id",
        s("graph_snapshot_id").alias("graph_snapshot_id"), s("built_at").alias("built_at"), *[field(n) for n in FIELDS], *[count(n) for n in COUNTS],
    )


def reissued(requests: DataFrame, snapshots: DataFrame, now: Column, last_id: int) -> tuple[DataFrame, int]:
    """Snapshots to append so that each request (task_id, site_id) has one of its own, and the last id given.

    A request that has one, or whose site has none, adds nothing; the others get their site's latest under their name.
    """
    asked = requests.select("task_id", "site_id").where("task_id is not null").dropDuplicates(["task_id"])
    lacking = _with_snapshot(asked, snapshots).where("by_task is null and by_site is not null").select(F.col("task_id").alias("for_task"), "by_site.*")
    named = F.coalesce(F.col("task_id").cast("string"), F.lit("")) != ""
    note = F.when(named, F.concat(F.lit(REUSED_NOTE), F.col("task_id").cast("string"), F.lit("."))).otherwise(REUSED_NOTE_NO_TASK)
    rows = lacking.withColumn("note", note).withColumn("built_at", now).drop("task_id", "graph_snapshot_id").withColumnRenamed("for_task", "task_id")
    given, last = numbered(rows, ["task_id"], last_id, "graph_snapshot_id")
    return given.select(snapshots.columns), last
