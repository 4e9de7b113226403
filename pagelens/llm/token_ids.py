"""Token ids of whole texts by a byte-level BPE vocabulary, batch-wise.

The vocabulary's pattern cuts a text into pieces that are encoded independently.
Cutting is done for a whole batch with numpy on code points; each different piece
goes through the tokenizer once and is remembered under two 64-bit hashes.  Texts with characters whose
Unicode class has changed over the versions, or that lie beyond U+2FFF, and texts
that hold the string of an added token go through the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from pagelens.llm.wordnum import U64, mix, powers, segments

LETTER, NUMBER, SPACE, UNSURE = 1, 2, 3, 9
LIMIT = 0x3000
MOST_REMEMBERED = 1 << 19
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# The characters that \s matches.
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The class of each code point and two 64-bit values of it."""
    kind = np.zeros(LIMIT + 1, np.uint8)
    for c in range(LIMIT):
        now, then = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        kind[c] = UNSURE if now[0] != then[0] else {"L": LETTER, "N": NUMBER}.get(now[0], 0)
    kind[list(SPACES)] = SPACE
    kind[LIMIT] = UNSURE
    every = np.arange(LIMIT + 1, dtype=np.uint64)
    return kind, (mix(every, 77), mix(every, 78))


def _piece_names(values: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values[codes] * powers(_BASE, len(codes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(codes))[starts] + (ends - starts).astype(np.uint64))


@lru_cache(1)
def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def _piece_starts(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces start; first: where texts start."""
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    start |= begins[:-1]
    # the last character of white space before other text goes to that text if it is U+0020, else stands alone
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begins[1:-1]) + 1
    start[after - 1] = True
    start[after] = codes[after - 1] != 32
    # 's 't 'm 'd 're 've 'll where a lone apostrophe starts a piece
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~begins[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = codes[quote + 1]
        beyond = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n)], codes[beyond], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 3, 0))
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        end = quote + length
        start[end[end < n]] = True
    return np.flatnonzero(start)


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    """The one of this worker process: the vocabulary is read once, not once a task."""
    return TokenIds(path)


class TokenIds:
    """ids(texts) -> (all ids as uint32, number of ids of each text)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # single ids wherever their strings stand
        self._forget()

    def _forget(self) -> None:
        """Known pieces: both hashes, sorted by the first, and where their ids lie in flat."""
        self.names, self.checks, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, names: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.searchsorted(self.names, names)
        self.begin = np.insert(self.begin, at, len(self.flat) + np.cumsum(size) - size)
        self.names, self.checks, self.size = np.insert(self.names, at, names), np.insert(self.checks, at, checks), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, *ids])

    def _missing(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.arange(len(names))
        return np.flatnonzero(self.names[np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)] != names)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of single pieces of the pattern, straight from the BPE model."""
        encode = self.tokenizer.model.tokenize
        return [np.array([t.id for t in encode(p.encode().decode("latin-1").translate(_byte_letters()))], np.uint32) for p in pieces]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds, code_hash = _classes()
        parts: list[np.ndarray | None] = [None] * len(texts)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        kind = kinds[np.minimum(codes, LIMIT)]
        odd = np.unique(np.searchsorted(first, np.flatnonzero(kind == UNSURE), "right") - 1)
        if any(t in joined for t in self.added):
            odd = np.union1d(odd, np.flatnonzero([any(t in text for t in self.added) for text in texts])).astype(np.int64)
        if len(odd):
            odd_set = set(odd.tolist())
            for i, ids in zip(odd.tolist(), self._whole([texts[i] for i in odd.tolist()])):
                parts[i] = ids
            plain = [i for i in range(len(texts)) if i not in odd_set]
            got, counts = self.ids([texts[i] for i in plain])
            for i, ids in zip(plain, np.split(got, np.cumsum(counts)[:-1]) if plain else []):
                parts[i] = ids
            return np.concatenate([p for p in parts if p is not None]), np.array([len(p) for p in parts if p is not None], np.int64)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = _piece_starts(codes, kind, first)
        ends = np.append(starts[1:], len(codes))
        names, checks = (_piece_names(values, codes, starts, ends) for values in code_hash)
        names, where, which = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) > MOST_REMEMBERED:
            self._forget()
        new = self._missing(names)
        if len(new):
            pieces = [joined[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            self._learn(names[new], checks[where[new]], self._pieces(pieces))
        known = np.searchsorted(self.names, names)
        if (self.checks[known][which] != checks).any():  # two pieces share a name: the tokenizer cuts these texts itself
            whole = self._whole(texts)
            return np.concatenate(whole), np.array([len(w) for w in whole], np.int64)
        counts = self.size[known][which]
        out = self.flat[np.repeat(self.begin[known][which], counts) + segments(counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        edge = np.searchsorted(starts, np.append(first, len(codes)))
        return out, np.diff(upto[edge])
