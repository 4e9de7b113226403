"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws the key -ln(u) / w with w its quality weight; ascending keys are
a weighted sample without replacement.  A source first gives its complete epochs;
the fraction left is the prefix of its documents in key order whose sizes add up to
the token budget.  The prefix sum has two levels: sizes by slice of the key range,
summed per source over the slices, and document by document only inside the one
slice where the budget ends.  There are about as many slices as a slice has rows, so
both levels grow with the root of the input.  No source is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import MOST_HOT, WORD, cut, spread_join

FEWEST_SLICES = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Quality weights of documents labelled good, not labelled, labelled bad.
GOOD, UNKNOWN, BAD = 2.0, 1.0, 0.5


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) -> with weight and target.

    Sources in code point order, null last, take the weights in turn.  Targets are
    weight * level, stopped at MOST_EPOCHS * source_size, with the level at which they
    sum to share * all sizes: sources stop in the order of cap / weight, so the level
    is the one after the longest stopped prefix.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", MOST_EPOCHS * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    all_sizes = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (share * all_sizes - F.col("before")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "source", "level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level["level"], F.col("cap"))))
    return ranked.select("source", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, own: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source) and labels (doc_id, quality) -> doc_id, size, source_size, target, taken, one row per row.

    size counts words; taken is how many of them the mix takes, repeats counted, at
    most twice the size.  A document at the end of the budget is taken in part.  Null
    text has size 0 and takes 0; a null source is a source of its own; labels may
    repeat (their mean counts) or lack a document.  Rows alike in doc_id and text draw
    the same key and are taken in any order among themselves.  Draws depend on doc_id
    and text alone, so reruns agree.  An empty table gives no rows.  own columns pass
    through.
    """
    own = own or []
    draw = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), draw.alias("draw"), *own)
    if labels is not None:
        quality = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("named")).agg(F.avg("quality").alias("quality")).withColumn("nameless", F.lit(0))
        # rows without doc_id match nothing and are dealt evenly
        drawn = drawn.withColumns({"named": F.coalesce("doc_id", F.lit(0).cast("long")), "nameless": F.when(F.col("doc_id").isNull(), 1 + F.floor(F.col("draw") * 4096).cast("int")).otherwise(0)})
        drawn = drawn.join(quality, ["named", "nameless"], "left").drop("named", "nameless")
    else:
        drawn = drawn.withColumn("quality", F.lit(None).cast("double"))
    weight = F.when(F.col("quality") >= 0.5, GOOD).when(F.col("quality") < 0.5, BAD).otherwise(UNKNOWN)
    # joins need a key that is never null
    drawn = drawn.withColumn("key", -F.log("draw") / weight).withColumn("origin", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    drawn = cut(drawn.drop("draw", "quality", "source"))
    slices = max(FEWEST_SLICES, math.isqrt(drawn.count()))
    drawn = drawn.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * slices).cast("int"))

    # the sums of the slices serve the sources' sizes too
    slices = cut(drawn.groupBy("origin", "slice").agg(F.sum("size").alias("sum"), F.count("*").alias("rows")))
    sizes = slices.groupBy("origin").agg(F.sum("sum").alias("source_size"))
    rows = slices.groupBy("origin").agg(F.sum("rows").alias("n"))
    sizes = sizes.select(F.expr("case when origin <> '' then substring(origin, 2) end").alias("source"), "source_size")
    plan = targets(sizes).withColumn("origin", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    running = F.sum("sum").over(Window.partitionBy("origin").orderBy("slice"))
    ends = slices.withColumn("upto", running).join(plan.select("origin", "budget"), "origin").where("upto >= budget")
    ends = ends.groupBy("origin").agg(F.min(F.struct("slice", "upto", "sum")).alias("end"))
    plan = cut(plan.join(ends, "origin", "left").select("origin", "source_size", "target", "epochs", "budget", F.col("end.slice").alias("last"), (F.col("end.upto") - F.col("end.sum")).alias("before")))

    # a row a source: broadcast while it is small, else each source's rows are dealt over several tasks
    placed = drawn.join(F.broadcast(plan), "origin") if plan.count() <= MOST_HOT else spread_join(drawn, plan.join(rows, "origin"), ["origin"])
    columns = ["doc_id", "size", "source_size", "target", *own]
    whole = placed.where("slice <> last or last is null")
    whole = whole.select(*columns, (F.col("size") * (F.col("epochs") + F.when(F.col("slice") < F.col("last"), 1).otherwise(0))).cast("long").alias("taken"))
    order = Window.partitionBy("origin").orderBy("key", "doc_id", "size")
    earlier = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("earlier")))
    last = placed.where("slice = last").withColumn("earlier", earlier)
    return whole.unionByName(last.select(*columns, (F.col("size") * F.col("epochs") + rest).cast("long").alias("taken")))


def take_mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then its first words for what is left; same columns."""
    names, kinds = docs.columns, dict(docs.dtypes)
    mixed = mix_sources(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("own_row")), labels, ["own_row"]).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = mixed.withColumn("turn", F.explode(F.sequence(F.lit(1), times))).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("turn") - 1) * F.col("size")))
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col("own_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("words")).cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), cut_text).otherwise(F.col("own_row.text"))
    out = each.withColumn("new_text", text)
    changed = {"text": F.col("new_text")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("words") < F.col("size"), F.length("new_text").cast(kinds["n_chars"])).otherwise(F.col("own_row.n_chars"))
    return out.select(*[changed.get(c, F.col(f"own_row.`{c}`")).alias(c) for c in names])


ORACLE = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         (('0x' || substr(md5(concat_ws(':', doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from documents),
q as (select doc_id, avg(quality) as quality from labels where doc_id is not null group by doc_id),
k as (select d.doc_id, d.source, d.size, -ln(u) / (case when quality >= 0.5 then {GOOD}::double when quality < 0.5 then {BAD}::double else {UNKNOWN}::double end) as key
      from d left join q on d.doc_id = q.doc_id),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, ([3.0::double, 1.0::double, 2.0::double])[1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as weight from s),
c as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as stop from w),
l as (select *, (1.5::double * (select sum(source_size) from s)::double
                 - coalesce(sum(cap) over (order by stop, source nulls last rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by stop, source nulls last rows between current row and unbounded following) as level from c),
f as (select min(level) as level from (select level from l where level <= stop order by stop, source nulls last limit 1)),
t as (select source, source_size, least(cap, coalesce(weight * f.level, cap)) as target from l, f),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
o as (select k.*, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size) as budget,
             coalesce(sum(k.size) over (partition by k.source order by key, doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as earlier
      from k join e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size, target,
       (size * epochs + greatest(0, least(size, budget - earlier)))::bigint as taken
from o
"""
