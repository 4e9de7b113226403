"""Substring dedup with a count-min prefilter.

A window is 50 consecutive words of one document.  Each window is represented by
an anchor, the least-hashed 25-word gram inside it; neighbouring windows mostly
share theirs, so there are about thirteen times fewer anchors than windows, and
equal windows always have equal anchors.  Pass one counts in how many documents
each anchor occurs in count-min sketches, one a partition, merged cell by cell;
what the sketch reports is never too small.  Its width follows the bytes of all texts up to
a bound, beyond which it filters less and the exact grouping works more.  Pass two keeps only the anchors that
are estimated to repeat and groups their windows exactly: runs of windows with
one anchor by the hash of all their words, and where the runs of an anchor
differ, window by window.  Only the sketch's one-bit-a-cell verdict (a fixed size)
is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.llm.common import cut, spread_join, text_bytes_total, text_key
from pagelens.llm.wordnum import U64, find_words, gram_hashes, mix, pieces, segments, sliding_min, text_bytes, word_hashes

WINDOW = 50
GRAM = 25
SKETCH_ROWS = 2
SLICES = 64  # a row's cells in equal parts
FEWEST_CELLS, MOST_CELLS = 20, 29  # powers of two; the verdict broadcast is SKETCH_ROWS * 2**29 bits, 128 MB, at most
BYTES_A_CELL = 5  # of text; an anchor takes some 80 bytes of it


def _anchors(piece: pa.RecordBatch) -> dict[str, np.ndarray] | None:
    """Runs of windows by anchor over a batch; None if no text has a whole window."""
    data, offsets = text_bytes(piece.column("text"))
    starts, ends, first = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    if not (counts >= WINDOW).any():
        return None
    gram, wide = gram_hashes(words, GRAM), gram_hashes(words, WINDOW, seed=2)
    here = np.flatnonzero(counts >= WINDOW)
    n = counts[here] - WINDOW + 1
    at = np.repeat(first[here], n) + segments(n)  # the first word of each window
    least = sliding_min(gram, WINDOW - GRAM + 1)[at]
    doc = np.repeat(here, n)
    new = np.ones(len(at), bool)  # a run ends where the text or the anchor changes
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    run = np.flatnonzero(new)  # a gram that comes back can hold an anchor for long: at most 26 windows a run
    new |= segments(np.diff(np.append(run, len(at)))) % (WINDOW - GRAM + 1) == 0
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(at)))
    return {"doc": doc[run], "anchor": least[run], "at": at[run] - first[doc[run]], "length": length, "run": run, "window": wide[at]}


def log_cells(total_bytes: int) -> int:
    """Cells in each of the sketch's rows, as a power of two."""
    return min(MOST_CELLS, max(FEWEST_CELLS, (total_bytes // BYTES_A_CELL).bit_length()))


def _cells(anchors: np.ndarray, log: int) -> Iterator[np.ndarray]:
    for row in range(SKETCH_ROWS):
        yield mix(anchors, 100 + row) >> U64(64 - log)


def _sketch(batches: Iterator[pa.RecordBatch], log: int) -> Iterator[pa.RecordBatch]:
    """This partition's sketch, held sparsely: each slice's cells, those counted twice or more listed twice."""
    held: list[np.ndarray] = []
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = _anchors(piece)
            if found is not None:
                order = np.lexsort((found["anchor"], found["doc"]))
                doc, anchor = found["doc"][order], found["anchor"][order]
                once = np.ones(len(doc), bool)  # a document counts once
                once[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[once])
    anchors = np.concatenate(held) if held else np.zeros(0, np.uint64)
    rows, blobs, width = [], [], (1 << log) // SLICES
    for row, cells in enumerate(_cells(anchors, log)):
        cells, times = np.unique(cells, return_counts=True)
        cells = np.repeat(cells, np.minimum(times, 2))
        cuts = np.searchsorted(cells, np.arange(SLICES + 1, dtype=np.uint64) * U64(width))
        for s in range(SLICES):
            part = cells[cuts[s] : cuts[s + 1]]
            if len(part):
                rows.append(row * SLICES + s)
                blobs.append((part - U64(s * width)).astype(np.uint32).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])


def _merge(batches: Iterator[pa.RecordBatch], log: int) -> Iterator[pa.RecordBatch]:
    """For each slice one bit a cell: does the sum over the partitions reach two?"""
    width = (1 << log) // SLICES
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for s, blob in zip(batch.column("slice").to_pylist(), batch.column("cells")):
            cells = np.frombuffer(blob.as_buffer(), np.uint32)
            once, twice = seen.setdefault(s, (np.zeros(width, bool), np.zeros(width, bool)))
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            twice[cells[once[cells]]] = True
            once[cells] = True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([np.packbits(t, bitorder="little").tobytes() for _, t in seen.values()], pa.binary())], ["slice", "bits"])


def repeated_cells(docs: DataFrame) -> np.ndarray:
    """The merged sketch's verdict, a bit a cell: SKETCH_ROWS rows of 2**log bits, log at most MOST_CELLS."""
    log = log_cells(text_bytes_total(docs))
    rows = docs.select("text").mapInArrow(lambda batches: _sketch(batches, log), "slice int, cells binary").repartition(SKETCH_ROWS * SLICES, "slice").mapInArrow(lambda batches: _merge(batches, log), "slice int, bits binary")
    bits = np.zeros((SKETCH_ROWS * SLICES, (1 << log) // SLICES // 8), np.uint8)
    for r in cut(rows).coalesce(8).toLocalIterator():  # merged in parallel, then fetched in a few parts
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def _runs(bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = (bits.value.shape[1] * 8).bit_length() - 1
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = _anchors(piece)
                if found is None:
                    continue
                keep = np.ones(len(found["anchor"]), bool)
                for row, cell in zip(bits.value, _cells(found["anchor"], log)):
                    keep &= (row[cell >> U64(3)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1
                keep = np.flatnonzero(keep)
                lengths, doc = found["length"][keep], found["doc"][keep]
                windows = found["window"][np.repeat(found["run"][keep], lengths) + segments(lengths)]
                # a run's name: its anchor, its length and its windows in order
                where = np.concatenate([[0], np.cumsum(lengths)])
                sums = np.zeros(len(windows) + 1, np.uint64)
                np.cumsum(mix(windows, 7) * (mix(segments(lengths).astype(np.uint64), 3) | U64(1)), out=sums[1:])
                name = mix(sums[where[1:]] - sums[where[:-1]] + lengths.astype(np.uint64), 9)
                ids = piece.column("doc_id").take(pa.array(doc))
                keys = piece.column("text_key").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(found["anchor"][keep].view(np.int64)), pa.array(name.view(np.int64)), pa.array(found["at"][keep].astype(np.int32)), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(windows.view(np.int64)))],
                    ["doc_id", "text_key", "anchor", "run", "at", "windows"],
                )

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, text_key) -> doc_id, text_key, gone: the windows whose words also start in a smaller doc_id.

    gone is an array of (at, mask): bit i of mask says that the window starting at
    word at + i repeats.  Rows without doc_id neither remove nor lose anything.
    """
    bits = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs))
    named = docs.where("doc_id is not null")
    runs = cut(named.mapInArrow(_runs(bits), "doc_id long, text_key long, anchor long, run long, at int, windows array<long>"))
    bits.destroy()  # the runs are written
    different = cut(runs.groupBy("anchor", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("windows").alias("windows"), F.count("*").alias("n")))
    # anchors with runs that differ: their windows one by one
    spread = different.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    single = spread_join(different.select("anchor", "run", "least", "windows"), spread, ["anchor"], deal=F.col("run")).select("anchor", "run", "least", F.posexplode("windows").alias("i", "window"))
    single = cut(single)
    first = single.groupBy("anchor", "window").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1")
    earlier = spread_join(single, first, ["anchor", "window"], deal=F.col("run")).where("first < least")
    earlier = earlier.groupBy("anchor", "run").agg(F.collect_list(F.struct("i", "first")).alias("earlier"))  # at most 26
    known = different.drop("windows").join(earlier, ["anchor", "run"], "left").where("least < most or earlier is not null").drop("most")
    # a document's window goes if the run's first owner or the window's is smaller
    hit = spread_join(runs.select("doc_id", "text_key", "anchor", "run", "at", F.size("windows").alias("size")), known, ["anchor", "run"])
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    by_window = F.aggregate(F.filter(F.coalesce("earlier", F.array().cast("array<struct<i:int,first:bigint>>")), lambda e: e["first"] < F.col("doc_id")), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(bit(e["i"])))
    mask = F.when(F.col("least") < F.col("doc_id"), bit(F.col("size")) - 1).otherwise(by_window)
    return hit.select("doc_id", "text_key", "at", mask.alias("mask")).where("mask <> 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "mask")).alias("gone"))


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = text_bytes(piece.column("text"))
            starts, ends, first = find_words(data, offsets)
            whole = data.tobytes()
            n_removed, digests, texts = [], [], []
            for i, gone in enumerate(piece.column("gone").to_pylist()):
                a, b = starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist()
                covered = np.zeros(len(a) + 1, np.int32)
                for run in gone or ():
                    for j in range(int(run["mask"]).bit_length()):
                        if run["mask"] >> j & 1:
                            covered[run["at"] + j] += 1
                            covered[run["at"] + j + WINDOW] -= 1
                stay = np.flatnonzero(np.cumsum(covered[:-1]) == 0) if gone else range(len(a))
                text = b" ".join([whole[a[j] : b[j]] for j in stay])
                n_removed.append(len(a) - len(stay))
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            out = {"doc_id": piece.column("doc_id"), "n_words": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                out["kept_text"] = pa.array(texts, pa.string())
                for name in piece.schema.names:
                    if name.startswith("own_"):
                        out[name] = piece.column(name)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256 (and kept_text): one row per row.

    A word goes if a window that covers it also starts in a document with a smaller
    doc_id, judged on the input.  Texts that are null, empty or shorter than a window
    lose nothing (null and empty keep the empty text).  Rows that share a doc_id never
    remove from each other; rows without doc_id are compared with nothing.  Columns
    named own_* pass through with with_text; no other column is read.  An empty table
    gives no rows.
    """
    own = [c for c in docs.columns if with_text and c.startswith("own_")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"), *own)
    found = keyed.join(repeats(keyed.select("doc_id", "text", "text_key")), ["doc_id", "text_key"], "left").select("doc_id", "text", "gone", *own)
    schema = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = StructType([*schema.add("kept_text", "string"), *(keyed.schema[c] for c in own)])
    return found.mapInArrow(lambda batches: _kept(batches, with_text), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text; texts that lose nothing stay as they are; same columns."""
    names, kinds = docs.columns, dict(docs.dtypes)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("own_row"))
    out = remove_repeats(packed, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("own_row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kinds.get("n_chars", "long"))).otherwise(F.col("own_row.n_chars")) if "n_chars" in names else None}
    return out.select(*[(changed[c] if changed.get(c) is not None else F.col(f"own_row.`{c}`")).alias(c) for c in names])


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) as p from d),
s as (select *, string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 49 following) as win from w),
f as (select win, min(doc_id) as first from s where p <= n - 49 group by win having count(distinct doc_id) > 1),
h as (select s.doc_id, s.p, s.word, coalesce(s.p <= s.n - 49 and f.first < s.doc_id, false)::int as hit from s left join f on s.win = f.win),
g as (select *, max(hit) over (partition by doc_id order by p rows between 49 preceding and current row) as gone from h),
k as (select doc_id, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by p) filter (where gone = 0) as kept from g group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on d.doc_id = k.doc_id
"""
