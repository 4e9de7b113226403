"""Packing along a space-filling curve.

Each document's hashed word vector is projected to three dimensions; documents are
range-partitioned and sorted by the Hilbert key of that point, so neighbours on the
curve, which use alike words, share sequences.  Each partition lays its documents
end to end and cuts the stream every 1024 tokens; what is left over at its end is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import partitions, text_bytes_total, text_key
from pagelens.llm.token_ids import token_ids
from pagelens.llm.wordnum import U64, find_words, mix, pieces, text_bytes, word_hashes

LENGTH = 1024
RANGE_BYTES = 32 << 20  # of text that a task packs
DIMENSIONS, BITS = 3, 10
_NORMAL = np.random.default_rng(11).standard_normal(1 << 16).astype(np.float32)


def hilbert_key(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of unsigned coordinates (the transpose method, on all rows at once)."""
    x = point.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _points(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the words' hashed normal vectors, scaled to unit variance, on a grid of 2**BITS steps."""
    counts = np.diff(first)
    out = np.zeros((len(counts), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sums = np.concatenate([[0.0], np.cumsum(_NORMAL[(mix(words, 50 + d) >> U64(48)).astype(np.int64)], dtype=float)])
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(counts, 1))
        out[:, d] = np.clip((np.tanh(mean / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = text_bytes(piece.column("text"))
            starts, ends, first = find_words(data, offsets)
            key = hilbert_key(_points(word_hashes(data, starts, ends, lower=True), first))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(key)], [*piece.schema.names, "curve"])


def _cut(edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut segments laid end to end (edges) at the sequences' bounds: each piece's begin, end, segment and sequence."""
    cuts = np.union1d(edges, bounds)
    cuts = cuts[cuts <= bounds[-1]]
    begin, end = cuts[:-1], cuts[1:]
    return begin, end, np.searchsorted(edges, begin, "right") - 1, np.searchsorted(bounds, begin, "right") - 1


def _packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sequence = token_ids(path), TaskContext.get().partitionId() << 33
        # of the stream not yet in a sequence: ids, and per segment document, start in it, its number of ids
        ids, doc, start, whole, sizes = np.zeros(0, np.uint32), [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(bounds: np.ndarray) -> pa.RecordBatch:
            nonlocal ids, doc, start, whole, sizes, sequence
            edges = np.concatenate([[0], np.cumsum(sizes)])
            begin, end, segment, number = _cut(edges, bounds)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([doc[i] for i in segment], pa.int64()), pa.array(start[segment] + begin - edges[segment]), pa.array(end - begin),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), end.tolist())], pa.int64()),
                    pa.array(whole[segment]), pa.array(number + sequence), pa.array(begin - bounds[number]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(bounds) - 1
            used = int(bounds[-1])
            keep = int(np.searchsorted(edges, used, "right")) - 1  # the segment that goes on, or the end
            into = used - edges[keep]
            ids, doc, start, whole, sizes = ids[used:], doc[keep:], start[keep:].copy(), whole[keep:], sizes[keep:].copy()
            if len(sizes):
                start[0] += into
                sizes[0] -= into
            return out

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                got, counts = tokens.ids([t or "" for t in piece.column("text").to_pylist()])
                last = np.cumsum(counts)
                ids = np.concatenate([ids, np.insert(got, last, 0).astype("<u4")])  # id 0 ends each document
                doc = [*doc, *piece.column("doc_id").to_pylist()]
                start, whole, sizes = np.concatenate([start, np.zeros(len(counts), np.int64)]), np.concatenate([whole, counts + 1]), np.concatenate([sizes, counts + 1])
                if len(ids) >= LENGTH:
                    yield rows(np.arange(0, len(ids) // LENGTH * LENGTH + 1, LENGTH))
        if len(ids):
            powers = [1 << b for b in range(9, -1, -1) if len(ids) >> b & 1]
            yield rows(np.cumsum([0, *powers]))

    return run


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    A document is its token ids and a final id 0, so a null or empty text is one
    token.  Each id lies in exactly one piece; pieces fill a sequence from offset 0
    without gaps.  Rows may repeat and doc_id may be null: every row is packed.  Other
    columns are not read.  An empty table gives no rows.  tokenizer: path of a
    byte-level BPE file that every executor has.
    """
    spark = docs.sparkSession
    schema = "doc_id long, text string, tie long"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("doc_id"), text_key()).alias("tie"))
    keyed = keyed.mapInArrow(_keyed, f"{schema}, curve long")
    # the tie spreads documents with one key (copies) over partitions
    ranges = max(partitions(spark), -(-text_bytes_total(docs) // RANGE_BYTES))
    dealt = keyed.repartitionByRange(ranges, "curve", "tie").sortWithinPartitions("curve", "tie", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(_packed(tokenizer), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
