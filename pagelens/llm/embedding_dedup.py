"""Embedding near-dedup by collision-counting projections.

Every unit vector is projected on M random directions.  Around each query's value a
window of half-width W catches the others; a pair at the threshold falls inside one
another's window with a known probability, so the number of windows of M that a
linked pair shares is binomial, and a pair is verified (cosine in double precision)
if its count reaches the quantile that loses a share MISS of pairs right at the
threshold.  Vectors are sorted by the first projection and dealt into blocks of
neighbours; blocks whose first projections lie further apart than SPREAD windows are
not met.  Windows of the other projections are not swept in their own sorted order: a
window that keeps a pair at the threshold with probability p holds at least p / 3.2 of
all pairs of a corpus without structure, so sweeping until no such pair is lost lists
each pair about three times.  Instead a block pair counts all its windows at once on
projections in steps of 1/32, where a shared window is one comparison of bytes, and
only verified links leave the task.  Work grows with the square of the different
vectors within reach, about 0.2 ns a projection and pair.

Equal vectors collapse first, so a group of copies of any size is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut, spread_join
from pagelens.llm.components import components

M = 48
MISS = 1e-4
STEPS = 32  # a unit of projection in steps; bytes hold -4..4
SPREAD = 5.0
BLOCK = 4096
ROWS = 512  # queries at a time


def window(threshold: float) -> int:
    """Half-width in steps: one standard deviation of the difference of two unit vectors at the threshold."""
    return max(1, round(sqrt(2 - 2 * threshold) * STEPS))


def least_count(threshold: float, m: int = M, miss: float = MISS) -> int:
    """The count that a pair at the threshold reaches with probability 1 - miss."""
    p = erf((window(threshold) - 0.5) / STEPS / sqrt(2 - 2 * threshold) / sqrt(2))
    below = 0.0
    for count in range(m + 1):
        below += comb(m, count) * p**count * (1 - p) ** (m - count)
        if below > miss:
            return count
    return m


@lru_cache(8)
def _directions(size: int, m: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, m))


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their projections; unusable ones (null or zero, null or non-finite components) get none."""
    for batch in batches:
        steps, order, sizes = [], [], []
        for v in batch.column("embedding"):
            x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
            norm = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.linalg.norm(x / np.abs(x).max())) if np.abs(x).max() else 0.0
            if not norm:
                steps.append(None), order.append(None), sizes.append(0)
                continue
            p = (x / np.abs(x).max() / norm) @ _directions(len(x), M)
            steps.append(np.clip(np.floor(p * STEPS) + 128, 0, 255).astype(np.uint8).tobytes())
            order.append(float(p[0]))
            sizes.append(len(x))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps, pa.binary()), pa.array(order, pa.float64()), pa.array(sizes, pa.int32())], [*batch.schema.names, "steps", "place", "size"])


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the edges a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _block_pair(threshold: float):
    half, enough = window(threshold), least_count(threshold)

    def run(table: pa.Table) -> pa.Table:
        block = np.asarray(table.column("block"))
        classes, copies = np.asarray(table.column("class").to_pylist(), object), np.asarray(table.column("copies"))
        steps = np.frombuffer(b"".join(table.column("steps").to_pylist()), np.uint8).reshape(-1, M)
        vectors = np.asarray(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(classes), -1)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        first, second = np.asarray(table.column("i"))[0], np.asarray(table.column("j"))[0]
        queries, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        columns = np.ascontiguousarray(steps[others].T)
        a, b = [], []
        for at in range(0, len(queries), ROWS):
            rows = queries[at : at + ROWS]
            count = np.zeros((len(rows), len(others)), np.uint8)
            for k in range(M):
                count += (columns[k] - steps[rows, k][:, None] + np.uint8(half)) <= 2 * half
            i, j = np.nonzero(count >= enough)
            i, j = rows[i], others[j]
            keep = i < j if first == second else slice(None)
            i, j = i[keep], j[keep]
            for part in range(0, len(i), 1 << 17):
                p, q = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
                near = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
                a.append(p[near])
                b.append(q[near])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        links = np.bincount(a, copies[b], len(classes)) + np.bincount(b, copies[a], len(classes))
        reach = _labels(a, b, len(classes))
        used = np.flatnonzero(links)
        return pa.table({"class": pa.array(classes[used], pa.string()), "links": pa.array(links[used].astype(np.int64)), "joined": pa.array(classes[reach[used]], pa.string())})

    return run


def block_partners(lows: list[float], highs: list[float], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the blocks that each sorted block meets."""
    return np.searchsorted(highs, np.subtract(lows, reach)), np.searchsorted(lows, np.add(highs, reach), "right") - 1


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept, one row per row.

    Vectors link at cosine >= threshold, in double precision.  Vectors that are null, empty or zero, or hold
    null or non-finite components, and vectors of different sizes, link with nothing.
    Copies link with each other and count as links one by one.  component_id is the
    smallest vec_id reachable; kept says it is this row's.  Rows without vec_id take
    part and get their component's smallest id, null if it has none; their kept is
    false if it has one, else true.  Vectors may be of any length.  Other columns are
    not read; an empty table gives no rows.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    # one class per different vector, named by two hashes (hashing skips nulls, so the size counts too)
    keyed = given.withColumn("class", F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64(F.lit(1), F.size("embedding"), "embedding")))
    found = keyed.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    schema = f"class string, copies long, least long, embedding {kind}, steps binary, place double, size int"
    classes = cut(found.select("class", "copies", "least", "embedding").mapInArrow(_projected, schema))
    usable = classes.where("steps is not null")

    n = usable.count()
    blocks = max(1, -(-n // BLOCK))
    cuts = usable.agg(F.percentile_approx("place", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()[0] or []
    cuts = sorted(set(cuts)) if blocks > 1 else []
    # a few numbers a block; a block of more rows than BLOCK (multiples of one vector) is dealt into parts
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("place"))) if cuts else F.lit(0)
    usable = usable.withColumn("slab", place.cast("int"))
    counts = dict.fromkeys(range(len(cuts) + 1), 0) | {r["slab"]: r["n"] for r in usable.groupBy("slab").agg(F.count("*").alias("n")).collect()}
    parts = np.array([max(1, -(-counts[i] // (2 * BLOCK))) for i in range(len(cuts) + 1)])
    first = np.concatenate([[0], np.cumsum(parts)])
    low, high = block_partners([-np.inf, *cuts], [*cuts, np.inf], SPREAD * window(threshold) / STEPS)
    of = lambda numbers: F.get(F.array(*[F.lit(int(x)) for x in numbers]), F.col("slab"))
    block = (of(first[:-1]) + F.pmod(F.xxhash64("class"), of(parts))).cast("int")
    dealt = usable.withColumn("block", block).withColumn("other", F.explode(F.sequence(of(first[low]), of(first[high + 1] - 1))))
    dealt = dealt.select("class", "copies", "embedding", "steps", "size", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    linked = cut(dealt.groupBy("i", "j", "size").applyInArrow(_block_pair(threshold), "class string, links long, joined string"))

    reached = components(linked.select(F.col("class").alias("u"), F.col("joined").alias("v")))
    sums = linked.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "copies", "least", "size").join(sums, "class", "left").join(reached.select(F.col("id").alias("class"), F.col("component").alias("group")), "class", "left")
    known = known.withColumn("group", F.coalesce("group", "class"))
    owners = cut(known.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    known = spread_join(known, owners, ["group"], deal=F.col("class")).select("class", "copies", "size", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = spread_join(cut(keyed.select("vec_id", "class")), known.withColumn("n", F.col("copies")), ["class"])
    alone = F.col("size") == 0
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    n_links = F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links")).cast("long")
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


ORACLE = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
l as (select a.vec_id as i, b.vec_id as j from u a join u b on a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r(i, j) as (select vec_id, vec_id from u union select r.i, l.j from r join l on r.j = l.i),
c as (select i, min(j) as component_id from r group by i), n as (select i, count(*) as n from l group by i)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from u join c on u.vec_id = c.i left join n on u.vec_id = n.i
"""
