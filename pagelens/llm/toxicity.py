"""Toxicity severity by cumulative-link ordinal regression.

P(grade >= k) = logistic(w.x - cut_k) with one weight vector for all ordered cuts; x
holds the log counts of a text's hashed words and word beginnings, and the output is the expected grade.  The model
is fitted on the driver from at most MOST_LABELLED labelled rows (the ones with the
smallest hash of their id), whose features are counted and screened by aggregations;
scoring is a pass over the whole texts in the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.llm.common import cut
from pagelens.llm.wordnum import SPACE, U64, find_words, mix, pieces, text_bytes, word_hashes

CELLS = 1 << 20
MOST_LABELLED = 12_000
SAMPLE_TASKS = 8  # tasks over the labelled sample, a bounded table
GRADES = 4  # 0 clean, 1 to 3 toxic
PREFIXES = (4, 5, 6, 7)
SCREEN = 6.0  # z value of a feature's mean among toxic against clean texts
PENALTY = 0.5
STEP = 1.0
SKETCH, BAND, ALIKE = 64, 4, 0.5  # min-hashes a sampled text, of a bucket, and their equal share in a family
#: ASCII white space, control characters and punctuation end a word here.
_BREAKS = SPACE.copy()
_BREAKS[:128] |= ~np.array([chr(c).isalnum() for c in range(128)])


def _features(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed feature of every word and of every proper prefix of PREFIXES bytes."""
    data, offsets = text_bytes(piece.column("text"))
    starts, ends, first = find_words(data, offsets, _BREAKS)
    rows, length = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), ends - starts
    found = [(rows, word_hashes(data, starts, ends, lower=True))]
    for n in PREFIXES:
        long = np.flatnonzero(length > n)
        found.append((rows[long], mix(word_hashes(data, starts[long], starts[long] + n, lower=True), n)))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> U64(44)).astype(np.int64)


def _values(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts, dtype=np.float32)


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            rows, cells = _features(piece)
            both, counts = np.unique(rows << 20 | cells, return_counts=True)
            at = pa.array(np.searchsorted(both >> 20, np.arange(piece.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (both & (CELLS - 1), counts)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), *lists], ["doc_id", "toxic", "cells", "counts"])


@dataclass
class Model:
    cells: np.ndarray  # sorted
    weights: np.ndarray
    cuts: np.ndarray  # ascending
    limit: float = 0.5  # of P(grade >= 1), beyond which a text is toxic

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each margin."""
        return 1 / (1 + np.exp(self.cuts - margin[:, None]))


@dataclass
class Sample:
    """Labelled texts (label and weight of each) and their entries: text, marking feature, log count."""

    toxic: np.ndarray
    weights: np.ndarray
    of: np.ndarray
    at: np.ndarray
    values: np.ndarray
    cells: np.ndarray  # sorted; entries point into it


def _min_hashes(rare: Broadcast):
    """Eight min-hashes of each text's cells that are set in rare; texts with fewer than four such cells give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, cells in zip(batch.column("doc_id").to_pylist(), batch.column("cells")):
                c = np.asarray(cells.values, np.int64)
                c = c[rare.value[c]].astype(np.uint64)
                if len(c) >= 4:
                    ids.append(i)
                    hashes.append([int(mix(c, 200 + k).min()) >> 1 for k in range(8)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SKETCH min-hashes of all cells of each text, however common they are; texts without words share one sketch."""
    draw = np.random.default_rng(11)
    by, plus = (draw.integers(0, 1 << 64, SKETCH, np.uint64, endpoint=False) for _ in range(2))
    by |= U64(1)
    for batch in batches:
        least = np.zeros((batch.num_rows, SKETCH), np.int64)
        for row, cells in zip(least, batch.column("cells")):
            hashes, whole = mix(np.asarray(cells.values, np.int64).astype(np.uint64), 199), np.full(SKETCH, ~U64(0))
            for at in range(0, len(hashes), 1 << 12):
                whole = np.minimum(whole, (hashes[at : at + (1 << 12), None] * by + plus).min(axis=0))
            row[:] = (whole >> U64(1)).astype(np.int64)
        hashes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * SKETCH, pa.int32()), pa.array(least.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), hashes], ["doc_id", "hashes"])


def family_weights(texts: DataFrame, ids: np.ndarray) -> np.ndarray:
    """For each of the sorted ids 1 / the number of sampled texts of its family: a family of copies counts about once.

    Copies and near copies (estimated Jaccard of all cells at least ALIKE) are joined
    first, families of any size.  Then texts join that share min-hashes of uncommon
    words; how common a word is, is counted over one text of each family, so copies do
    not make their own words common.  One bit a cell, SKETCH and eight hashes a sampled
    text reach the driver.
    """
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    table = texts.mapInArrow(_sketches, "doc_id long, hashes array<long>").toArrow().sort_by("doc_id")
    sketch = np.asarray(table.column("hashes").combine_chunks().flatten(), np.int64).reshape(len(ids), SKETCH)
    for k in range(0, SKETCH, BAND):
        buckets: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            met = buckets.setdefault(sketch[i, k : k + BAND].tobytes(), [])
            alike = [j for j, share in zip(met, np.mean(sketch[met] == sketch[i], axis=1)) if share >= ALIKE] if met else []
            for j in alike:
                root[find(i)] = find(j)
            if not alike:
                met.append(i)
    one = np.unique([find(i) for i in range(len(ids))]).astype(np.int64)
    ones = texts.sparkSession.createDataFrame(pa.table({"doc_id": ids[one]}))
    seen = texts.join(F.broadcast(ones), "doc_id").select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    rare = np.zeros(CELLS, bool)
    rare[np.asarray(seen.where("n between 2 and 50").select("cell").toArrow().column("cell"), np.int64)] = True
    shared = texts.sparkSession.sparkContext.broadcast(rare)
    first: dict[tuple[int, ...], int] = {}
    table = texts.mapInArrow(_min_hashes(shared), "doc_id long, hashes array<long>").toArrow().sort_by("doc_id")
    for i, least in zip(np.searchsorted(ids, np.asarray(table.column("doc_id"), np.int64)).tolist(), table.column("hashes").to_pylist()):
        for k in range(4):
            root[find(i)] = find(first.setdefault((k, *least[2 * k : 2 * k + 2]), i))
    shared.destroy()
    family = [find(i) for i in range(len(ids))]
    return 1 / np.bincount(family, minlength=1)[family] if len(ids) else np.zeros(0)


def screened(entries: DataFrame, n: tuple[float, float]) -> DataFrame:
    """Cells whose mean value is higher among toxic texts than chance allows; n: weight of the toxic and of the clean texts."""
    total, toxic = sum(n), F.col("toxic") == 1
    weighted = F.col("weight") * F.col("value")
    sums = entries.groupBy("cell").agg(
        *[F.coalesce(F.sum(F.when(side, weighted)), F.lit(0.0)).alias(name) for side, name in ((toxic, "bad"), (~toxic, "good"))],
        F.sum(weighted * F.col("value")).alias("squares"), F.coalesce(F.sum(F.when(toxic, F.col("weight"))), F.lit(0.0)).alias("often"),
    )
    mean = (F.col("bad") + F.col("good")) / total
    spread = (F.col("squares") / total - mean * mean) * (1 / n[0] + 1 / n[1])
    z = (F.col("bad") / n[0] - F.col("good") / n[1]) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    return sums.where((F.col("often") >= 3) & (z > SCREEN)).select("cell")


def severity_grades(sample: Sample) -> np.ndarray:
    """Grades from binary labels: clean 0, toxic 1 to 3 in thirds of the log counts of features that mark toxic texts."""
    grades, n = np.zeros(len(sample.toxic), np.int64), len(sample.toxic)
    marks = np.bincount(sample.of, sample.values, n)
    toxic = np.flatnonzero(sample.toxic > 0)
    rank = np.argsort(np.argsort(marks[toxic], kind="stable"), kind="stable")
    grades[toxic] = 1 + rank * (GRADES - 1) // max(len(toxic), 1)
    return grades


def fit(sample: Sample, grades: np.ndarray, rounds: int = 500) -> Model:
    """Maximum likelihood of the ordinal model under an L1 penalty, by proximal gradient steps on sparse entries.

    Without toxic texts nothing is learnt and every text is clean.
    """
    kept, share = sample.cells, sample.weights
    n, total = len(grades), share.sum()
    if not len(kept) or not grades.max(initial=0):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 30.0))
    margin = lambda w: np.bincount(sample.of, w[sample.at] * sample.values, n)
    w, cuts = np.zeros(len(kept)), np.linspace(3, 6, GRADES - 1)
    # accumulated squared gradients scale the steps, rare and frequent features alike
    scale_w, scale_c = np.full(len(kept), 1e-8), np.full(GRADES - 1, 1e-8)
    rows = np.arange(n)
    for _ in range(rounds):
        s = np.ones((n, GRADES + 1))
        s[:, GRADES] = 0
        s[:, 1:GRADES] = 1 / (1 + np.exp(np.clip(cuts - margin(w)[:, None], -40, 40)))
        up, down = s[rows, grades], s[rows, grades + 1]
        between = np.maximum(up - down, 1e-9)
        g_w = np.bincount(sample.at, (share * (up + down - 1))[sample.of] * sample.values, len(kept)) / total
        g_c = np.zeros(GRADES + 1)
        np.add.at(g_c, grades, share * up * (1 - up) / between)
        np.add.at(g_c, grades + 1, -share * down * (1 - down) / between)
        g_c = g_c[1:GRADES] / total
        scale_w, scale_c = scale_w + g_w**2, scale_c + g_c**2
        step = STEP / np.sqrt(scale_w)
        w = w - step * g_w
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY / total, 0)
        cuts = np.maximum.accumulate(cuts - STEP / np.sqrt(scale_c) * g_c + np.arange(GRADES - 1) * 1e-6)
    used = np.flatnonzero(w)
    # the limit that all but one in a thousand clean labelled texts stay under
    p = 1 / (1 + np.exp(np.clip(cuts[0] - margin(w)[grades == 0], -40, 40)))
    return Model(kept[used], w[used], cuts, float(np.clip(np.quantile(p, 0.999), 0.15, 0.5)) if len(p) else 0.5)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Sample:
    """At most `most` labelled documents with the entries of their marking features.

    Several labels of a document count as their maximum, several texts as the least of
    them.  Counts and screening of the features are aggregations over the sample; only
    the features that pass the screen reach the driver.
    """
    spark = docs.sparkSession
    few = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).coalesce(SAMPLE_TASKS)
    texts = cut(texts.mapInArrow(_cells_of, "doc_id long, toxic int, cells array<int>, counts array<int>"))
    marks = texts.select("doc_id", "toxic").toArrow().sort_by("doc_id")
    ids, toxic = np.asarray(marks.column("doc_id"), np.int64), np.asarray(marks.column("toxic"), np.int64)
    if not (toxic > 0).any():  # nothing to tell apart
        none = np.zeros(0, np.int64)
        return Sample(toxic, np.ones(len(ids)), none, none, np.zeros(0), none)
    weights = family_weights(texts, ids)
    weighed = spark.createDataFrame(pa.table({"doc_id": ids, "weight": weights}))
    entries = texts.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.inline(F.arrays_zip(F.col("cells").alias("cell"), F.col("counts").alias("count"))).alias("cell", "count"))
    entries = entries.withColumn("value", F.log1p("count"))
    n = [max(float(weights[(toxic > 0) == side].sum()), 1) for side in (True, False)]
    kept = screened(entries.join(F.broadcast(weighed), "doc_id"), tuple(n)).toArrow().sort_by("cell").column("cell")
    cells = np.asarray(kept, np.int64)
    found = entries.join(F.broadcast(spark.createDataFrame(pa.table({"cell": kept}))), "cell").select("doc_id", "cell", "value").toArrow().sort_by([("doc_id", "ascending"), ("cell", "ascending")])
    of, at = np.searchsorted(ids, np.asarray(found.column("doc_id"), np.int64)), np.searchsorted(cells, np.asarray(found.column("cell"), np.int64))
    return Sample(toxic, weights, of, at, np.asarray(found.column("value"), float), cells)


def _scored(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        place = np.full(CELLS, -1, np.int32)
        place[m.cells] = np.arange(len(m.cells))
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows, cells = _features(piece)
                here = place[cells]
                used = np.flatnonzero(here >= 0)
                both, counts = np.unique(rows[used] * CELLS + here[used], return_counts=True)
                p = m.at_least(np.bincount(both // CELLS, m.weights[both % CELLS] * _values(counts), piece.num_rows))
                out = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1)), pa.array(p[:, 0] > m.limit)]
                kept = [i for i, name in enumerate(piece.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*(piece.columns[i] for i in kept), *out], [*(piece.schema.names[i] for i in kept), "severity", "p_toxic", "grade", "toxic"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, own: str | None = None) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, severity, p_toxic, grade, toxic (and the own column), one row per row.

    severity is the expected grade of 0..3, toxic says that P(grade >= 1) is above
    the model's limit, which 99.9 % of the clean labelled texts stay under (at most 0.5).  Null and empty texts have no words and score as such.  Labels without id
    or value are left out; without toxic labels nothing is toxic.  Rows may repeat and
    doc_id may be null; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, most_labelled)
    model = spark.sparkContext.broadcast(fit(sample, severity_grades(sample)))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([own] if own else []))
    schema = StructType([f for f in given.schema if f.name != "text"]).add("severity", "double").add("p_toxic", "double").add("grade", "long").add("toxic", "boolean")
    return given.mapInArrow(_scored(model), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones; same columns."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("own_row"))
    return score_toxicity(packed, labels, own="own_row").where("not toxic").select(*[F.col(f"own_row.`{c}`").alias(c) for c in names])
