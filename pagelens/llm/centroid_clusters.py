"""Centroid clustering with heap-ordered bounds, exact on integers.

Vectors are packed into blocks, one row a block, so that a block's state travels with
its vectors.  In a block each cluster keeps a heap of its vectors by gap: the distance
to the second-nearest centroid less that to the nearest, plus the drift that the
cluster had gathered when the gap was taken.  When centroids move, a cluster's drift
grows by its own centroid's step and the largest step of any other; a gap at most the
drift has expired, and only such vectors are popped, compared with all centroids in
integers, and pushed on the heap of their nearest.  A vector whose gap stands is
strictly nearest to its centroid, so no tie hides behind a bound; gaps are lessened by
more than doubles can err.

A block also returns what moved: for each cluster the change of its count and sums.
They are added up in Spark; the driver holds the centroids and their sums only.
Numbers beyond SMALL are computed as Python integers and always compared anew.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut

K = 16
ROUNDS = 3
SIZE = 64
SCALE = 64
BLOCK = 4096
SMALL = 2**22  # squared distances of 64 such numbers are exact in a double
LIMB = 40  # bits of a part of a sum
MOST = 2**63 - 1
ERR = 1e-12

_CHANGE = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("vectors", pa.binary()), ("clusters", pa.binary()), ("keys", pa.binary()), ("rows", pa.binary()), ("sizes", pa.list_(pa.int32())), ("rescanned", pa.int32()), ("changes", _CHANGE)])
STATE = "ids array<long>, kind string, vectors binary, clusters binary, keys binary, rows binary, sizes array<int>, rescanned int, changes array<struct<cluster:int,place:int,limb:int,value:long>>"


def _packed(scale: int):
    """Blocks of integer vectors, each in the narrowest type that holds its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.floor(np.asarray(part.column("embedding").flatten(), np.float64) * scale)
                top = np.abs(x).max(initial=0)
                kind = next((k for k in ("i1", "i2", "i4") if top <= np.iinfo(k).max), "f8")
                yield pa.RecordBatch.from_pylist([{"ids": part.column("vec_id").to_pylist(), "kind": kind, "vectors": x.astype(kind).tobytes(), "sizes": [], "rescanned": 0, "changes": []}], _STATE)

    return run


@dataclass
class Centroids:
    """Centroids, what their clusters sum to, and the drift of each so far."""

    points: list[list[int]]
    sums: list[list[int]] = field(default_factory=list)  # count first
    drift: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.sums = self.sums or [[0] * (len(p) + 1) for p in self.points]
        self.drift = self.drift or [0.0] * len(self.points)

    def moved(self, changes: list[tuple[int, int, int, int]]) -> Centroids:
        sums = [list(s) for s in self.sums]
        for cluster, place, limb, value in changes:
            sums[cluster][place] += value << (LIMB * limb)
        points = [[x // s[0] for x in s[1:]] if s[0] else p for p, s in zip(self.points, sums, strict=True)]
        steps = [_root(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) for p, q in zip(points, self.points, strict=True)]
        others = [max(steps[:i] + steps[i + 1 :], default=0.0) for i in range(len(steps))]
        return Centroids(points, sums, [d + (a + b) * (1 + ERR) for d, a, b in zip(self.drift, steps, others, strict=True)])


def _root(x: int) -> float:
    try:
        return math.sqrt(x)
    except OverflowError:
        return math.inf


def _distances(x: np.ndarray, points: list[list[int]]) -> np.ndarray:
    """Squared distances, exact: doubles while all numbers are small, else Python integers."""
    if len(x) == 0 or (x.dtype.kind == "i" and np.abs(x.astype(np.int64)).max(initial=0) <= SMALL and max(abs(c) for p in points for c in p) <= SMALL):
        x, c = x.astype(np.float64), np.asarray(points, np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    rows = [[int(v) for v in row] for row in x]
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, p, strict=True)) for p in points] for row in rows], object)


def _gaps(d: np.ndarray, nearest: np.ndarray, drift: list[float]) -> np.ndarray:
    """How far each vector's nearest centroid leads, less what doubles can err, plus its cluster's drift."""
    if d.dtype == object:
        return np.full(len(d), -np.inf)
    rows = np.arange(len(d))
    upper, rest = np.sqrt(d[rows, nearest]), np.sqrt(d.astype(np.float64))
    rest[rows, nearest] = np.inf
    lower = rest.min(axis=1)
    offset = np.asarray(drift)[nearest]
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(lower), np.inf, lower - upper - ERR * (lower + upper + offset) + offset)


def _changes(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """Count and sums that each cluster gains or loses; before: -1 where a vector had no cluster."""
    out, move = [], before != after
    for clusters, sign in ((before[move], -1), (after[move], 1)):
        for cluster in np.unique(clusters[clusters >= 0]):
            rows = x[move][clusters == cluster]
            totals = rows.astype(np.int64).sum(0).tolist() if rows.dtype.kind == "i" else [sum(int(v) for v in column) for column in rows.T]
            for place, total in enumerate([len(rows), *totals]):
                limb, rest = 0, abs(total)
                while rest:
                    value = (rest & ((1 << LIMB) - 1)) * sign * (1 if total > 0 else -1)
                    if value:
                        out.append({"cluster": int(cluster), "place": place, "limb": limb, "value": value})
                    limb, rest = limb + 1, rest >> LIMB
    return out


def _assigned(centroids: Centroids):
    """One round over blocks: pops what has expired, compares it with all centroids, pushes it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, drift = len(centroids.points), centroids.drift
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(n, -1)
                if row["clusters"] is None:
                    before, heaps, expired = np.full(n, -1), [[] for _ in range(k)], list(range(n))
                else:
                    before, expired = np.frombuffer(row["clusters"], "i4"), []
                    pairs = list(zip(np.frombuffer(row["keys"], "f8").tolist(), np.frombuffer(row["rows"], "i4").tolist(), strict=True))
                    ends = np.cumsum([0, *row["sizes"]])
                    heaps = [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    for cluster, heap in enumerate(heaps):
                        while heap and heap[0][0] <= drift[cluster]:
                            expired.append(heapq.heappop(heap)[1])
                after = before.copy()
                if expired:
                    d = _distances(x[expired], centroids.points)
                    nearest = d.argmin(axis=1) if d.dtype != object else np.array([min(range(k), key=r.__getitem__) for r in d.tolist()])
                    after[expired] = nearest
                    for cluster, gap, i in zip(nearest.tolist(), _gaps(d, nearest, drift).tolist(), expired, strict=True):
                        heapq.heappush(heaps[cluster], (gap, i))
                pairs = [p for heap in heaps for p in heap]
                state = {"clusters": after.astype("i4").tobytes(), "keys": np.array([p[0] for p in pairs], "f8").tobytes(), "rows": np.array([p[1] for p in pairs], "i4").tobytes(), "sizes": [len(h) for h in heaps]}
                yield pa.RecordBatch.from_pylist([row | state | {"rescanned": len(expired), "changes": _changes(x, before, after)}], _STATE)

    return run


def _measured(points: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["ids", "kind", "vectors", "clusters"]).to_pylist():
                x, clusters = np.frombuffer(row["vectors"], row["kind"]).reshape(len(row["ids"]), -1), np.frombuffer(row["clusters"], "i4")
                distance = np.zeros(len(x), object)
                for cluster in np.unique(clusters):
                    distance[clusters == cluster] = _distances(x[clusters == cluster], [points[cluster]])[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(clusters), pa.array([min(int(d), MOST) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def usable(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding, in doubles, of vectors of the given size whose scaled components are finite."""
    x = F.col("embedding").cast("array<double>")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    finite = lambda v: F.coalesce(F.abs(v * scale) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above all
    return given.where((F.size("embedding") == size) & F.forall("embedding", finite))


def clustered(kept: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame | None, Centroids, list[int]]:
    """Blocks with their last assignment, the centroids it was made to, and the vectors compared anew in each assignment."""
    order = [F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), "vec_id", "embedding"]
    first = kept.where("vec_id is not null").orderBy(*order).limit(k).select("embedding").collect()
    centroids = Centroids([[math.floor(scale * x) for x in r.embedding] for r in first])
    if not first:
        return None, centroids, []
    state, rescanned = kept.mapInArrow(_packed(scale), STATE), []
    for r in range(rounds + 1):
        state = cut(state.mapInArrow(_assigned(centroids), STATE))
        rescanned.append(state.agg(F.sum("rescanned")).first()[0])
        if r < rounds:  # k * (size + 1) sums, each in a few parts
            changes = state.select(F.inline("changes")).groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value"))
            centroids = centroids.moved([tuple(c) for c in changes.collect()])
    return state, centroids, rescanned


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    One row for each vector of the given size without null or non-finite components, as integers floor(scale * x);
    other vectors give none.  The k vectors with least sha256 of ``1:<vec_id>`` start (ties: vec_id, then
    components), fewer if there are fewer; a vector without vec_id is clustered but starts no centroid, and if all
    lack one, the other columns are null.  Equally near centroids: the smaller number.  Empty clusters keep their
    centroid.  Distances and inertias above 2**63 - 1 are given as that.  Other columns are not read; an
    empty table gives no rows.
    """
    kept = usable(vectors, size, scale)
    state, centroids, _ = clustered(kept, k, rounds, scale)
    if state is None:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = state.mapInArrow(_measured(centroids.points), "vec_id long, cluster int, distance long")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, min(total, MOST), min(sum(sums.values()), MOST), sha256(",".join(map(str, centroids.points[c])).encode()).hexdigest()) for c, total in sums.items()]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, any_value(e) as e, min({{'d': d, 'c': c}}) as near from (
          select v.vec_id, v.e, c{r}.c, (list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c{r}.e) + list_inner_product(c{r}.e, c{r}.e))::bigint as d from v cross join c{r}) group by vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} as (select c, list(x order by i) as e from (select c, i, floor(sum(x) / count(*)) as x from (select near.c as c, unnest(e) as x, generate_subscripts(e, 1) as i from a{r}) group by c, i) group by c),
        c{r + 1} as materialized (select c{r}.c, coalesce(s{r}.e, c{r}.e) as e from c{r} left join s{r} on c{r}.c = s{r}.c)""")
    return f"""
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(embedding) = 64),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, e from v order by c limit 16),
{", ".join(steps)}
select vec_id, near.c::int as cluster, near.d as distance, (sum(near.d) over (partition by near.c))::bigint as cluster_inertia, (sum(near.d) over ())::bigint as inertia,
sha256(array_to_string(list_transform(c{rounds}.e, lambda x: x::bigint), ',')) as centroid_sha256 from a{rounds} join c{rounds} on near.c = c{rounds}.c
"""


ORACLE = _oracle()
