"""Line dedup: hashed lines in one order over all documents, first occurrences streamed.

Every line of at least ``least_chars`` code points becomes a 128-bit hash of its key
(white space stripped, A-Z lower-cased), one row for a key and document.  The rows are
range-partitioned and sorted by hash, then document from the largest id down, so each
task streams its keys and meets the document that keeps a line first.  A key's run may
pass from one range to the next, so a very common line is shared by several tasks: a
first pass notes the first and last run of each range (one small row a range), from
which the driver knows what precedes and follows them.  The result is a compressed
bitmap of the lines that each document keeps; texts are not moved to find it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelens.llm.common import cut

BLANK = b" \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # of bytes: A-Z only


def row_key() -> Column:
    """Tells apart different texts under one doc_id."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 24))


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashed_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text")), strict=True):
                lines, places = text.split(b"\n"), {}
                for at, line in enumerate(lines):
                    if len(line) >= least_chars and _long_enough(line := line_key(line), least_chars):
                        places.setdefault(blake2b(line, digest_size=16).digest(), []).append(at)
                out += [(h, doc_id, key, len(lines), at) for h, at in places.items()]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return run


LINES = "line binary, doc_id long, row_key binary, n_lines int, places array<int>"
_LINES = pa.schema([("line", pa.binary()), ("doc_id", pa.int64()), ("row_key", pa.binary()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32()))])


def _batch(rows: list[tuple], schema: pa.Schema = _LINES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Run(NamedTuple):
    """The documents of one line in one range: first and last met, how many (no more than matter)."""

    line: bytes
    first: int
    last: int
    docs: int


def _edges(most: int):
    """The first and the last run of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Run | None = None
        line, first, last, docs, part, runs = None, 0, 0, 0, 0, 0
        for batch in batches:
            for line_, doc, part in zip(*(batch.column(c).to_pylist() for c in ("line", "doc_id", "part")), strict=True):
                if line_ != line:
                    if runs == 1:
                        head = Run(line, first, last, docs)
                    line, first, last, docs, runs = line_, doc, doc, 1, min(2, runs + 1)
                elif doc != last:
                    last, docs = doc, min(most, docs + 1)
        if line is not None:
            tail = Run(line, first, last, docs)
            head = head or tail
            yield pa.RecordBatch.from_pylist([{"part": part, "alone": runs == 1} | {f"head_{k}": v for k, v in head._asdict().items()} | {f"tail_{k}": v for k, v in tail._asdict().items()}], _EDGES)

    return run


_RUN = {"line": pa.binary(), "first": pa.int64(), "last": pa.int64(), "docs": pa.int32()}
_EDGES = pa.schema([("part", pa.int32()), ("alone", pa.bool_()), *((f"{end}_{k}", t) for end in ("head", "tail") for k, t in _RUN.items())])
EDGES = "part int, alone boolean, " + ", ".join(f"{end}_line binary, {end}_first long, {end}_last long, {end}_docs int" for end in ("head", "tail"))


def _joined(a: Run, b: Run) -> Run:
    return Run(a.line, a.first, b.last, a.docs + b.docs - (a.last == b.first))


def neighbours(edges: list[tuple[int, bool, Run, Run]]) -> dict[int, tuple[Run | None, Run | None]]:
    """For each range, in order: what precedes its first run and what follows its last, of the same line."""
    before, after, carry = {}, {}, None
    for part, alone, head, tail in edges:
        before[part] = carry if carry and carry.line == head.line else None
        carry = _joined(before[part], tail) if alone and before[part] else tail
    carry = None
    for part, alone, head, tail in reversed(edges):
        after[part] = carry if carry and carry.line == tail.line else None
        carry = _joined(head, after[part]) if alone and after[part] else head
    return {part: (before[part], after[part]) for part in before}


def _dropped(beside, least_docs: int):
    """Places of lines that go: of lines in least_docs documents, all but those of the first document met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pending = [], []
        line = last = None
        docs, before, after, sure, started = 0, None, None, False, False
        for batch in batches:
            for line_, doc, key, n_lines, places, part in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if line_ != line:
                    pending, sure = [], False
                    if not started:
                        started, (before, after) = True, beside.value[part]
                    else:
                        before = None
                    docs, last, line = (before.docs, before.last, line_) if before else (0, None, line_)
                if doc != last:
                    docs, last = docs + 1, doc
                if after is not None and after.line == line:
                    sure = sure or docs + after.docs - (after.first == last) >= least_docs
                sure = sure or docs >= least_docs
                if docs > 1:
                    pending.append((doc, key, n_lines, places))
                if sure and pending:
                    out += pending
                    pending = []
                    if len(out) > 20_000:
                        yield _batch(out, _GONE)
                        out = []
        yield _batch(out, _GONE)

    return run


_GONE = pa.schema(list(_LINES)[1:])
GONE = LINES.partition(", ")[2]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps, gone = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[places] = False
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
            gone.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_key", "n_lines")), pa.array(gone, pa.int32()), pa.array(keeps, pa.binary())], ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def kept_lines(keep: bytes | None, lines: list[bytes]) -> list[bytes]:
    """The lines that a bitmap keeps; without one, all."""
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [lines[i] for i in np.flatnonzero(bits)]


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_key, n_lines, n_dropped, keep: a row for each document that loses a line.

    keep holds a bit a line (zlib over packed bits, first line in the highest bit); row_key tells apart texts under one
    doc_id.  Rows that share a doc_id are one document.  Rows without doc_id count for nothing and
    lose nothing.  A null text is an empty one.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text)
    order = [F.col("line"), F.col("doc_id").desc(), F.col("row_key")]
    lines = cut(given.mapInArrow(_hashed_lines(least_chars), LINES).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    # a row a range: some hundred bytes for each of the tasks that sorted the lines
    edges = sorted(lines.select("line", "doc_id", "part").mapInArrow(_edges(least_docs), EDGES).collect())
    runs = [(e.part, e.alone, *(Run(bytes(e[f"{end}_line"]), e[f"{end}_first"], e[f"{end}_last"], e[f"{end}_docs"]) for end in ("head", "tail"))) for e in edges]
    beside = docs.sparkSession.sparkContext.broadcast(neighbours(runs))
    gone = lines.mapInArrow(_dropped(beside, least_docs), GONE)
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")
    found = gone.groupBy("doc_id", "row_key").agg(F.first("n_lines").alias("n_lines"), places)
    return found.mapInArrow(_bitmaps, "doc_id long, row_key binary, n_lines int, n_dropped int, keep binary")


def _with_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return rows.join(bitmaps.select("doc_id", "row_key", "keep"), ["doc_id", "row_key"], "left")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, digests = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            lines = text.split(b"\n")
            kept = kept_lines(keep, lines)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            digests.append(sha256(b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_dropped, kept_sha256, one row for each row of docs.

    A line goes if its key has least_chars code points and stands in least_docs documents, unless its document has the
    largest doc_id of them; see keep_bitmaps for nulls, ties and repeated rows.  Other columns
    are not read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = _with_bitmaps(given, keep_bitmaps(docs, least_chars, least_docs))
    return found.select("doc_id", "text", "keep").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _shortened(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    return texts.combine(keeps, lambda text, keep: text if keep is None else b"\n".join(kept_lines(keep, text.encode().split(b"\n"))).decode())


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with the repeated lines gone from its texts, all columns and rows as they were; rules as in dedup_lines."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"))
    found = _with_bitmaps(rows, keep_bitmaps(docs, least_chars, least_docs))
    whole = F.col("row").getField("text")
    text = F.when(F.col("keep").isNull(), whole).otherwise(F.pandas_udf(_shortened, StringType())(F.coalesce(whole, F.lit("")), "keep"))
    return found.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.place, k.line, coalesce(k.doc_id <> c.keeper, false) as gone from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
