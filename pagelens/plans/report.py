"""Markdown reports: one text per site, built by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.modules import DIMENSIONS
from pagelens.operators.scores import COMPOSITE


def site_reports(summaries: DataFrame, actions: DataFrame) -> DataFrame:
    """site summaries and action plan -> site_id, file_name, markdown."""
    c = F.col
    lines = [F.concat(F.lit(f"| {d} | "), c(DIMENSIONS[d]).cast("string"), F.lit(f" | {w:.0%} |")) for d, w in COMPOSITE.items()]
    steps = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("1. **"), "priority", F.lit("** "), "dimension", F.lit(" ("), c("score").cast("string"), F.lit(")")).alias("line"))))
    plan = actions.groupBy("site_id").agg(F.transform(steps, lambda s: s["line"]).alias("steps"))
    joined = summaries.join(plan, "site_id", "left")
    head = F.array(F.concat(F.lit("# Site audit: "), "host"), F.lit(""), F.concat(F.lit("Composite score: "), c("composite_score").cast("string"), F.lit(" ("), "status", F.lit(")")), F.lit(""), F.lit("| dimension | score | weight |"), F.lit("| --- | --- | --- |"))
    text = F.array_join(F.concat(head, F.array(*lines), F.array(F.lit(""), F.lit("## Next steps"), F.lit("")), F.coalesce("steps", F.array().cast("array<string>"))), "\n")
    return joined.select("site_id", F.concat(F.regexp_replace("host", "[^a-z0-9]+", "-"), F.lit("-"), F.substring("site_id", 1, 8), F.lit(".md")).alias("file_name"), text.alias("markdown"))
