"""Word hashing over Arrow string batches with numpy.

A batch of texts becomes one byte array; words are runs of bytes other than
ASCII white space (0x20, 0x09-0x0D), which never split a UTF-8 sequence.  Word
and n-gram hashes are polynomials modulo 2**64 read off prefix sums, so one pass
of a few vectorised operations handles every word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD_BASE = U64(0x9E3779B97F4A7C15)
_GRAM_BASE = U64(0xD6E8FEB86659FD93)
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: U64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(base)] = have
    return have[:n]


def inverse(base: U64) -> U64:
    return U64(pow(int(base), -1, 1 << 64))


_WORD_INVERSE, _GRAM_INVERSE = inverse(_WORD_BASE), inverse(_GRAM_BASE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offset of each text (null: empty), len(column) + 1 offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most_bytes of text each (one long text may exceed it)."""
    lengths = np.asarray(pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0))
    total, first = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most_bytes:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if batch.num_rows > first:
        yield batch.slice(first)


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more at the end)."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = breaks[data]
    edge = np.zeros(n + 1, bool)  # a text ends where the next begins, without white space between
    edge[offsets] = True
    starts = np.flatnonzero(~gap[1:] & (gap[:-1] | edge))
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (lower: A-Z count as a-z)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODE if lower else _BYTE_CODE)[data] * powers(_WORD_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_WORD_INVERSE, len(data))[starts])


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i:i+n] for each i that has n words after it; texts are told apart by the caller."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, 17 * seed + 5) * powers(_GRAM_BASE, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(_GRAM_INVERSE, len(words))[: len(words) - n + 1], seed)


def sequence_hashes(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the whole word sequence of each text."""
    counts = np.diff(first)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, 31 + seed) * powers(_GRAM_BASE, int(counts.max(initial=1)))[segments(counts)], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ counts.astype(np.uint64), seed)


def segments(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    total = int(counts.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - first


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i:i+width] for each i."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
