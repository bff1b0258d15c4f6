"""Vectorised reading of whole texts: words, lines and hashes over Arrow buffers.

A word is `[^\\x20\\x09-\\x0D]+`. Texts stay UTF-8: none of the separators is part of a
longer UTF-8 sequence, so bytes can be classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 19  # bytes of text handled at once; bounds the memory of a task
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RAW = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] = np.arange(97, 123)
LONG = 512  # bytes beyond which a string is hashed by itself: polynomials modulo 2^64 are weak there
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _INV)):
                p = np.full(n, b, U)
                p[0] = 1
                _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Prefix:
    """Polynomial prefix sums of a byte buffer: the hash of any substring of up to LONG bytes in O(1)."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        n = len(buf)
        self.buf, self.lower = buf, lower
        self.up, self.down = _powers(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(n + 1, U)
            self.sums[0] = 0
            np.cumsum((_LOWER if lower else _RAW)[buf] * self.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            part = self.buf[starts[i] : ends[i]]
            data = (_DOWN[part] if self.lower else part).tobytes()
            out[i] = int.from_bytes(blake2b(data, digest_size=8).digest(), "little")
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each text (n+1)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    start, end = word.copy(), word.copy()
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    joined = word[:-1].copy()
    joined[cuts - 1] = False
    start[1:] &= ~joined
    joined = word[1:].copy()
    joined[cuts - 1] = False
    end[:-1] &= ~joined
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, over pieces of the buffer so that memory stays bounded."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        piece = Prefix(buf[lo : ends[j - 1]], lower)
        out[i:j] = piece.of(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


_SALTS = mix(np.arange(1, 65, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and the index of its text.

    A text of 1 to k-1 words has its whole sequence as its one shingle.
    """
    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n_words)), count)
    begin = np.repeat(first[:-1], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(k, n_words)[doc]
    out = mix(length.astype(U))
    padded = np.concatenate([words, np.zeros(k, U)])
    with np.errstate(over="ignore"):
        for i in range(k):
            out = np.where(length > i, mix(out + padded[begin + i] * _SALTS[i]), out)
    return out, doc


def distinct_sets(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, end to end, and n+1 offsets. `doc` ascends."""
    at = np.searchsorted(doc, np.arange(n + 1))
    h = hashes.copy()
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            h[i:j].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(n + 1))


def set_prints(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of each set, as two signed 64-bit columns; empty sets get 0, 0."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ salt))])
            part = total[offs[1:]] - total[offs[:-1]]
            out.append(np.where(np.diff(offs) > 0, mix(part + np.diff(offs).astype(U) * salt), U(0)).view(np.int64))
    return out[0], out[1]


def text_shingles(column: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a column of texts: (from, to, sorted distinct shingle hashes, offsets)."""
    buf, offs = utf8(column)
    for i, j in slices(offs):
        part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(part, own)
        h, doc = shingle_hashes(word_hashes(part, starts, ends, lower), first, k)
        sets, at = distinct_sets(h, doc, j - i)
        yield i, j, sets, at
