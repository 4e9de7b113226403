"""MinHash near-dedup by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles.  A shingle weighs its
count in the document times the mean inverse document frequency of its words,
where document frequencies are counted over the whole corpus into 2**20 hashed
cells (the hashing-TF way) and the idf is scaled to 1..2, so that the weights of
one corpus differ by a factor of two at most apart from the counts.  Consistent
weighted samples of these sets agree with the probability of their weighted
Jaccard similarity; bands of samples propose candidates, and every candidate is
verified on its whole shingle sets.

Groups of any size cost a linear number of rows: equal texts collapse first; each
band bucket proposes its hub (the member that meets most others over all bands)
against the others; documents still outside the component of their bucket's hub
are then compared with the rest of the bucket exactly, as a query set in blocks
whose similarities are matrix products, of which only the links come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut, hot_keys, spread_join, text_key
from pagelens.llm.components import components
from pagelens.llm.wordnum import U64, find_words, gram_hashes, mix, pieces, sequence_hashes, text_bytes, word_hashes
from pagelens.operators.shared import numbered

SHINGLE = 5
CELLS = 1 << 20
SLICES = 64
BANDS, ROWS = 12, 3
BLOCK = 512  # documents a side of a block
FEW = 8  # buckets up to this size list their pairs
NEAR = 1e-5  # similarities of blocks that lie so near the threshold are computed again pair by pair


# -- document frequencies -------------------------------------------------


def _frequency_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per non-empty slice of this partition's document counts."""
    counts, docs = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = text_bytes(piece.column("text"))
            starts, ends, first = find_words(data, offsets)
            cells = word_hashes(data, starts, ends, lower=True) & U64(CELLS - 1)
            doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
            once = np.unique(doc << U64(20) | cells) & U64(CELLS - 1)
            counts += np.bincount(once.astype(np.int64), minlength=CELLS)
            docs += len(offsets) - 1
    parts = counts.reshape(SLICES, -1)
    used = [-1, *np.flatnonzero(parts.any(axis=1)).tolist()]
    blobs = [np.array([docs]).tobytes(), *(parts[s].tobytes() for s in used[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each slice; holds one array a slice, whatever the number of partitions."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, blob in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            part = np.frombuffer(blob.as_buffer(), np.int64)
            sums[s] = sums[s] + part if s in sums else part.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])


def word_weights(docs: DataFrame) -> np.ndarray:
    """idf of each hashed cell, scaled to 1..2, over all rows of docs (text).  At most CELLS numbers reach the driver."""
    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(_frequency_slices, schema).repartition(SLICES, "slice").mapInArrow(_add_slices, schema).collect()
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    n = int(found.pop(-1, np.zeros(1, np.int64))[0])
    counts = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for s, part in found.items():
        counts[s] = part
    return (1 + np.log((n + 1) / (counts.ravel() + 1)) / np.log(n + 2)).astype(np.float32)


# -- weighted shingle sets ------------------------------------------------


def _one_set(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of one document and their weights; a text of 1 to 4 words is one shingle."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    grams = gram_hashes(words, n, seed=1)
    sums = np.zeros(len(words) + 1)
    np.cumsum(idf[(words & U64(CELLS - 1)).astype(np.int64)], out=sums[1:])
    weights = (sums[n:] - sums[:-n]) / n
    order = np.argsort(grams)
    grams, weights = grams[order], weights[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    at = np.flatnonzero(new)
    return grams[at], (weights[at] * np.diff(np.append(at, len(grams)))).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima; 0 where a set is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum(dtype=float)
    return float(least / (a[1].sum(dtype=float) + b[1].sum(dtype=float) - least))


# -- consistent weighted samples ------------------------------------------


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Quantiles of Gamma(2, 1) and of the uniform distribution, by 16 hash bits."""
    grid = np.linspace(0, 40, 1 << 20)
    middle = (np.arange(1 << 16) + 0.5) / (1 << 16)
    gamma = np.interp(middle, 1 - (1 + grid) * np.exp(-grid), grid).astype(np.float32)
    return gamma, (1 / gamma).astype(np.float32), np.log(gamma), middle.astype(np.float32)


def samples(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples of each set; sets lie end to end from starts.

    Sample i of a set is the element with the least a = c / (y e^r) with its
    level t, where ln y = r (t - b), t = floor(ln w / r + b), and r, c ~ Gamma(2, 1)
    and b ~ U(0, 1) depend on element and i alone.
    """
    gamma, inverse, log_gamma, uniform = _tables()
    log_w = np.log(weights)
    out = np.empty((len(starts), k), np.uint32)
    for i in range(k):
        x = (grams ^ U64(0xA24BAED4963EE407 * (2 * i + 1) % 2**64)) * U64(0x9FB21C651E98DF25)
        y = (x ^ (x >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
        at_r, at_c, at_b = (x >> U64(48)).astype(np.int64), (y >> U64(48)).astype(np.int64), ((y >> U64(32)) & U64(0xFFFF)).astype(np.int64)
        b = uniform[at_b]
        t = np.floor(log_w * inverse[at_r] + b)
        key = (log_gamma[at_c] - gamma[at_r] * (t - b + 1)).view(np.uint32)
        key = np.where(key >> np.uint32(31), ~key, key | np.uint32(1 << 31))
        name = (grams >> U64(32)).astype(np.uint32) + t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
        out[:, i] = np.minimum.reduceat(key.astype(np.uint64) << U64(32) | name, starts) & U64(0xFFFFFFFF)
    return out


def _signatures(idf: Broadcast, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                data, offsets = text_bytes(piece.column("text"))
                starts, ends, first = find_words(data, offsets)
                words = word_hashes(data, starts, ends, lower=True)
                sets = [_one_set(words[a:b], idf.value) for a, b in zip(first[:-1], first[1:])]
                sizes = np.array([len(s[0]) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), bands), np.uint64)
                if len(full):
                    grams, weights = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
                    got = samples(grams, weights, (np.cumsum(sizes) - sizes)[full], bands * rows).astype(np.uint64)
                    for band in range(bands):
                        key = np.full(len(full), band, np.uint64)
                        for row in range(rows):
                            key = mix(key ^ got[:, band * rows + row], row)
                        keys[full, band] = key
                whole = [sequence_hashes(words, first, half) for half in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), piece.column("text_key"), *(pa.array(w.view(np.int64)) for w in whole), pa.array(sizes), lists],
                    ["doc_id", "text_key", "w1", "w2", "n_shingles", "bands"],
                )

    return run


def _verified(idf: Broadcast, threshold: float):
    """Keep the pairs (id, hub) whose texts are alike; rows of one hub lie together, so its set is made once."""

    def one(text: str) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(pa.array([text], pa.large_string()))
        starts, ends, _ = find_words(data, offsets)
        return _one_set(word_hashes(data, starts, ends, lower=True), idf.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for text, other in zip(batch.column("text"), batch.column("text_hub")):
                other = other.as_py()
                if held is None or other != last:
                    last, held = other, one(other)
                keep.append(similarity(one(text.as_py()), held) >= threshold)
            yield batch.select(["id", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(left: list, right: list) -> np.ndarray:
    """Sum of minimum weights for each pair of weighted sets; works through the shared shingles 4096 at a time.

    Weights of one shingle are whole multiples of its idf, so a minimum is a sum
    over levels of products of 0/1 memberships.
    """
    total = np.zeros((len(left), len(right)))
    grams = [np.concatenate([x[0] for x in side]) for side in (left, right)]
    weights = [np.concatenate([x[1] for x in side]) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(x[0]) for x in side]) for side in (left, right)]
    shared = np.intersect1d(*grams)
    at = [np.searchsorted(shared, g) for g in grams]
    use = [np.flatnonzero(shared[np.minimum(i, max(len(shared) - 1, 0))] == g) if len(shared) else np.zeros(0, int) for i, g in zip(at, grams)]
    at, weights, owner = ([x[u] for x, u in zip(side, use)] for side in (at, weights, owner))
    unit = np.full(len(shared), np.inf)
    for i, w in zip(at, weights):
        np.minimum.at(unit, i, w)
    most = max([1.0, *(float((w / unit[i]).max()) for i, w in zip(at, weights) if len(i))])
    for first in range(0, len(shared), 4096):
        cells = [np.zeros((len(side), min(4096, len(shared) - first)), np.float32) for side in (left, right)]
        for cell, i, w, o in zip(cells, at, weights, owner):
            here = (i >= first) & (i < first + 4096)
            cell[o[here], i[here] - first] = w[here]
        total += np.minimum(cells[0], unit[first : first + 4096].astype(np.float32)) @ (cells[1] > 0).astype(np.float32).T
        if most > 1.0001:  # repeated shingles: what both have beyond the least weight
            rest = [np.maximum(c - unit[first : first + 4096].astype(np.float32), 0) for c in cells]
            columns = np.flatnonzero(rest[0].any(axis=0) & rest[1].any(axis=0))
            for j in columns:
                total += np.minimum.outer(rest[0][:, j], rest[1][:, j])
    return total


def _block_links(idf: Broadcast, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("query"))
        ids, parts = np.asarray(table.column("id")), np.asarray(table.column("c"))
        data, offsets = text_bytes(table.column("text").combine_chunks())
        starts, ends, first = find_words(data, offsets)
        words = word_hashes(data, starts, ends, lower=True)
        sets = [_one_set(words[a:b], idf.value) for a, b in zip(first[:-1], first[1:])]
        q, m = np.flatnonzero(side), np.flatnonzero(~side)
        u, v = [], []
        if len(q) and len(m):
            least = _overlaps([sets[i] for i in q], [sets[i] for i in m])
            full = np.array([s[1].sum(dtype=float) for s in sets])
            share, apart = least / (full[q][:, None] + full[m] - least), parts[q][:, None] != parts[m]
            alike = (share >= threshold) & apart
            for row, other in np.argwhere((np.abs(share - threshold) <= NEAR) & apart):  # products are in single precision
                alike[row, other] = similarity(sets[q[row]], sets[m[other]]) >= threshold
            for row in np.flatnonzero(alike.any(axis=1)):
                others = m[alike[row]]
                for other in others[np.unique(parts[others], return_index=True)[1]]:  # one link joins a component
                    u.append(min(ids[q[row]], ids[other]))
                    v.append(max(ids[q[row]], ids[other]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


# -- the operator ---------------------------------------------------------


def _sorted(side: DataFrame) -> DataFrame:
    """Join it by sorting: both sides are dealt by a key of few rows, and to broadcast one after all takes the driver a stage, a table and two blocks more."""
    return side.hint("merge")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per row: doc_id, text_key, n_shingles, class_id, kept.

    class_id is the smallest doc_id among the texts reachable by links of weighted
    Jaccard similarity >= threshold; kept says that this row has that doc_id, and of several texts
    of the class under it the one with the least text_key.  Different texts may share a doc_id: each
    links by itself, and two classes whose smallest doc_id is the same have the same class_id.
    Words are runs of non-space characters without regard to ASCII case; equal word
    sequences are copies.  Texts without a word (null, empty, white space) link with
    nothing.  A row without doc_id is compared with nothing, has no class_id and is
    kept.  Repeated rows appear as often as given.  Other columns are not read.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    idf = spark.sparkContext.broadcast(word_weights(docs))
    signed = cut(docs.withColumn("text_key", text_key()).mapInArrow(_signatures(idf, bands, rows), "doc_id long, text_key long, w1 long, w2 long, n_shingles long, bands array<long>"))
    # one node per different word sequence, numbered in the order of their smallest doc_ids, which different texts may share
    nodes = signed.where("doc_id is not null and n_shingles > 0").groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "text_key")).alias("own"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    nodes = cut(numbered(nodes.select("w1", "w2", "own.*", "bands", "n"), ["doc_id", "w1", "w2"], 0, "id")[0])
    placed = nodes.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = cut(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    hot = cut(hot_keys(shared, ["bucket"]))  # hubs and sizes have the same buckets
    members = cut(spread_join(placed, shared.withColumn("size", F.col("n")), ["bucket"], deal=F.col("id"), hot=hot))
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = members.join(_sorted(score), "id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top"), F.count("*").alias("n"))
    hubs = cut(hubs.select("bucket", (-F.col("top.minus")).alias("hub"), "n"))
    members = cut(spread_join(members, hubs, ["bucket"], deal=F.col("id"), hot=hot))
    ordered = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    pairs = cut(members.where("id <> hub").select("id", "hub").distinct())

    compared = nodes.join(_sorted(pairs.select(F.explode(F.array("id", "hub")).alias("id")).distinct()), "id", "left_semi").select("id", "doc_id", "text_key")
    texts = docs.withColumn("text_key", text_key()).join(_sorted(compared), ["doc_id", "text_key"]).select("id", "text")
    texts = cut(texts.dropDuplicates(["id"]))

    def verify(candidates: DataFrame) -> DataFrame:
        """Written candidates (id, hub) -> links (u, v); a hub's text is copied once for every HOT candidates, not into one task."""
        sizes = cut(candidates.groupBy("hub").agg(F.count("*").alias("n")))
        theirs = _sorted(sizes).join(texts.select(F.col("id").alias("hub"), F.col("text").alias("text_hub")), "hub")
        both = spread_join(_sorted(candidates).join(texts, "id"), theirs, ["hub"], deal=F.col("id"), hot=cut(hot_keys(sizes, ["hub"])))
        return both.select("id", "hub", "text", "text_hub").mapInArrow(_verified(idf, threshold), "id long, hub long").select(*ordered("id", "hub"))

    found = components(verify(pairs))
    # who is outside the component of a bucket's hub meets the bucket's members of other components
    of_hub = hubs.join(_sorted(found.select(F.col("id").alias("hub"), F.col("component").alias("c_hub"))), "hub", "left").select("bucket", "n", F.coalesce("c_hub", "hub").alias("c_hub"))
    here = members.where("size > 2").join(_sorted(found.select("id", F.col("component").alias("c"))), "id", "left").withColumn("c", F.coalesce("c", "id"))
    here = cut(spread_join(here, of_hub, ["bucket"], deal=F.col("id"), hot=hot).select("bucket", "id", "hub", F.col("size").alias("n"), "c", "c_hub"))
    queries, others = here.where("c <> c_hub"), here.where("id <> hub")
    few = _sorted(queries.where(F.col("n") <= FEW).select("bucket", "id", "c")).join(others.where(F.col("n") <= FEW).select("bucket", F.col("id").alias("hub"), F.col("c").alias("c_b")), "bucket")
    few = few.where("c <> c_b").select(F.least("id", "hub").alias("id"), F.greatest("id", "hub").alias("hub")).distinct()
    few = cut(_sorted(few).join(pairs.select(F.least("id", "hub").alias("id"), F.greatest("id", "hub").alias("hub")), ["id", "hub"], "left_anti"))
    # larger buckets: queries and members are dealt into blocks, every query block meets every member block
    sizes = cut(queries.where(F.col("n") > FEW).groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks"), F.ceil(F.max("n") / BLOCK).alias("m_blocks"), F.max("n").alias("n")))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = [
        spread_join(queries.drop("n"), sizes, ["bucket"], deal=F.col("id"), hot=hot).select("bucket", "id", "c", F.lit(True).alias("query"), block("q_blocks").alias("i"), every("m_blocks").alias("j")),
        spread_join(others.drop("n"), sizes, ["bucket"], deal=F.col("id"), hot=hot).select("bucket", "id", "c", F.lit(False).alias("query"), every("q_blocks").alias("i"), block("m_blocks").alias("j")),
    ]
    blocks = _sorted(dealt[0].unionByName(dealt[1])).join(texts, "id").groupBy("bucket", "i", "j").applyInArrow(_block_links(idf, threshold), "u long, v long")
    more = [] if few.isEmpty() else [cut(verify(few))]
    more += [] if sizes.isEmpty() else [cut(blocks)]
    more = reduce(DataFrame.unionByName, more) if more else None
    idf.destroy()  # all that reads it is written
    if more is not None and not more.isEmpty():  # the stars found so far stand for their links
        found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))

    # a class has the doc_id of its first node, and that node's text stays
    first = nodes.select(F.col("id").alias("component"), F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"))
    owners = nodes.select("id", "w1", "w2", "n").join(_sorted(found), "id", "left").withColumn("component", F.coalesce("component", "id")).join(first, "component").select("w1", "w2", "n", "class_id", "class_key")
    signed = signed.drop("bands")
    hot = cut(hot_keys(nodes.select("w1", "w2", "n"), ["w1", "w2"]))
    linked = spread_join(signed.where("n_shingles > 0 and doc_id is not null"), owners, ["w1", "w2"], hot=hot).select("doc_id", "text_key", "n_shingles", "class_id", "class_key")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"))
    kept = F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)) & (F.col("class_key") == F.col("text_key"))
    return linked.unionByName(alone).withColumn("kept", kept).drop("class_key")


def keep_one_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without the near copies: of each class the row of its smallest doc_id stays, once; same columns.

    Of rows alike in doc_id and text the one stays whose other columns come first as JSON.
    """
    names = docs.columns
    kept = near_duplicates(docs, threshold).where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    others = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), (F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("")).alias("tie"))
    named = packed.where("id is not null").join(kept, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("row", "tie").alias("row"))
    return named.select("row").unionByName(packed.where("id is null").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
