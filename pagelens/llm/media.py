"""Media columns: a Spark data source over archives of images.

Writing puts each payload into a PNG of 64 columns of 8-bit RGB samples (192 bytes a
row) and the PNGs of a task into one ZIP archive, stored.  Reading plans byte ranges
over the archives from their sizes alone; each task takes the archive's directory
and reads the members that start inside its range, several a request and batch by
batch through Arrow.  A member that fails is read again by its own offset, without
touching the others.
Archives of attempts that did not commit are not in the manifest and never read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pagelens.llm.common import shared_folder

ROW = 192  # bytes of a row: 64 pixels of three samples
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 4
SCHEMA = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_png(text: bytes) -> bytes:
    """text padded with spaces to a positive multiple of 192, as 8-bit samples; its own length in the private chunk nbYt."""
    padded = text + b" " * (ROW - len(text) if not text else -len(text) % ROW)
    rows = np.zeros((len(padded) // ROW, ROW + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(padded, np.uint8).reshape(-1, ROW)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"nbYt", struct.pack(">Q", len(text))) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[int, bytes]:
    """(length before padding, samples) of a PNG that to_png wrote; damage raises ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, length, body = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(name + part):
            raise ValueError(f"damaged chunk {name!r}")
        if name == b"nbYt":
            (length,) = struct.unpack(">Q", part)
        elif name == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
    if length is None or rows[:, 0].any():
        raise ValueError("no length or a filter that is not 0")
    return length, rows[:, 1:].tobytes()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Written(WriterCommitMessage):
    def __init__(self, name: str, size: int):
        self.name, self.size = name, size


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = _open(self.uri)
        store.create_dir(path)
        name, n = f"{uuid.uuid4().hex}.zip", 0
        with store.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in iterator:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    archive.writestr(zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}.png"), to_png((text.as_py() or "").encode()))
                    n += 1
        if not n:  # an archive without members has nothing to seek in
            store.delete_file(f"{path}/{name}")
            return _Written("", 0)
        return _Written(name, store.get_file_info(f"{path}/{name}").size)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = _open(self.uri)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/manifest.json") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.name]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, path = _open(self.uri)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/{m.name}")


class _Range(InputPartition):
    def __init__(self, name: str, first: int, last: int):
        super().__init__((name, first, last))


class _Reader(DataSourceReader):
    def __init__(self, uri: str, range_bytes: int):
        self.uri, self.range_bytes = uri, range_bytes

    def partitions(self) -> list[_Range]:
        store, path = _open(self.uri)
        with store.open_input_stream(f"{path}/manifest.json") as f:
            archives = json.loads(f.read())
        return [_Range(name, first, first + self.range_bytes) for name, size in archives for first in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        name, first, last = partition.value
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
        if not name:
            return
        store, path = _open(self.uri)
        with store.open_input_file(f"{path}/{name}") as file, zipfile.ZipFile(file) as archive:
            members = sorted((m for m in archive.infolist() if first <= m.header_offset < last), key=lambda m: m.header_offset)
        rows, held = [], 0
        for member, (png, (length, payload)) in zip(members, read_members(store, f"{path}/{name}", members)):
            digits = member.filename.partition("/")[2].removesuffix(".png")
            rows.append((int(digits) if digits else None, length, payload, len(png), hashlib.sha256(png).hexdigest()))
            held += len(payload)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def spans(members: list[zipfile.ZipInfo], most: int = BATCH_BYTES) -> Iterator[list[zipfile.ZipInfo]]:
    """Neighbouring members that are read with one request, about `most` bytes together (one member may exceed it)."""
    part: list[zipfile.ZipInfo] = []
    for member in members:
        if part and member.header_offset + member.compress_size - part[0].header_offset > most:
            yield part
            part = []
        part.append(member)
    if part:
        yield part


def _parse(member: zipfile.ZipInfo, data: bytes, at: int) -> tuple[bytes, tuple[int, bytes]]:
    """The member whose local header begins at data[at]; damage raises ValueError."""
    head = data[at : at + 30]
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {member.header_offset}")
    begin = at + 30 + sum(struct.unpack_from("<HH", head, 26))
    png = data[begin : begin + member.file_size]
    if len(png) != member.file_size or zlib.crc32(png) != member.CRC:
        raise ValueError(f"damaged member at {member.header_offset}")
    return png, from_png(png)


def read_members(store: fs.FileSystem, path: str, members: list[zipfile.ZipInfo]) -> Iterator[tuple[bytes, tuple[int, bytes]]]:
    """Members in order, a span of them a request; one that fails is read again alone by its own offset."""
    for part in spans(members):
        begin, tail = part[0].header_offset, part[-1]
        try:
            with store.open_input_file(path) as file:
                data = file.read_at(tail.header_offset - begin + 30 + 2 * len(tail.filename.encode()) + 64 + tail.file_size, begin)
        except OSError:
            data = b""
        for member in part:
            try:
                found = _parse(member, data, member.header_offset - begin)
            except ValueError:
                found = read_member(store, path, member)
            yield found


def read_member(store: fs.FileSystem, path: str, member: zipfile.ZipInfo, attempts: int = ATTEMPTS) -> tuple[bytes, tuple[int, bytes]]:
    """One member's bytes and payload, read by its offset with an own handle; tried again alone, then the task fails."""
    for attempt in range(attempts):
        try:
            with store.open_input_file(path) as file:
                head = file.read_at(30, member.header_offset)
                if len(head) < 30:
                    raise ValueError(f"no member at {member.header_offset}")
                data = head + file.read_at(sum(struct.unpack_from("<HH", head, 26)) + member.file_size, member.header_offset + 30)
            return _parse(member, data, 0)
        except (OSError, ValueError):
            if attempt + 1 == attempts:
                raise
            time.sleep(0.1 * 2**attempt)
    raise AssertionError("attempts must be positive")


class MediaArchive(DataSource):
    """format("media_archive"): path, a folder URI that driver and executors see; range_bytes, of one read task."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [p.as_buffer() for p in batch.column("payload")]
        digests, tails, features = [], [], []
        for p in payloads:
            samples = np.frombuffer(p, np.uint8)
            digests.append(hashlib.sha256(p).hexdigest())
            tails.append(zlib.crc32(samples[-16:].tobytes()))
            histogram = np.bincount(samples >> 4, minlength=16)
            means = samples.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (len(samples) // 3)
            features.append(f"64x{len(samples) // ROW} rgb={'/'.join(map(str, means))} hist={'.'.join(map(str, histogram * 255 // len(samples)))}")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array([p.size for p in payloads], pa.int64()), pa.array(digests), pa.array(tails, pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(features)],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def store_media(docs: DataFrame, uri: str) -> None:
    """Write the texts of docs (doc_id, text) as images into archives under uri."""
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).write.format("media_archive").mode("append").option("path", uri).save()


def read_media(spark: SparkSession, uri: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, payload, media_bytes, media_sha256 of every stored member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", uri).option("range_bytes", range_bytes).load()


def media_features(docs: DataFrame, uri: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Everything is computed from the bytes read back.  Null and empty texts become one
    row of 192 spaces with n_bytes 0.  Equal texts give equal values; rows may repeat
    and doc_id may be null.  Other columns are not read; an empty table gives no rows.
    """
    uri = uri or f"{shared_folder(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    store_media(docs, uri)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_media(docs.sparkSession, uri).mapInArrow(_features, schema)
