"""Token ids of whole texts by a public byte-level BPE, each distinct word encoded once.

The tokenizer splits a text by a fixed pattern and encodes the parts one by one. Here the
parts are found with array operations on the bytes, and only parts not met before go to
the tokenizer; a worker keeps what it has encoded. Texts with characters whose class the
tables below do not settle (apostrophes, rare spaces, anything from U+0250 on), and texts
that hold the string of an added token, are given to the tokenizer whole, so ids are those
of the file as loaded in every case.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Prefix, slices, utf8

MAX_KNOWN = 1 << 20
_LETTER, _NUMBER, _OTHER, _SPACE, _ASK = range(5)


@cache
def _classes() -> np.ndarray:
    out = np.full(0x250, _OTHER, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind, _OTHER)
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x27, 0x85, 0xA0]] = _ASK
    return out


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _holds_added(texts: pa.Array, path: str) -> np.ndarray:
    """Whether each text holds the string of an added token; those are matched before the pattern."""
    out = np.zeros(len(texts), bool)
    for token in _tokenizer(path).get_added_tokens_decoder().values():
        out |= pc.fill_null(pc.match_substring(texts, token.content), False).to_numpy(zero_copy_only=False)
    return out


class _Known:
    """Ids of the parts met so far, found by a 64-bit hash of their bytes."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self):
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, keys: np.ndarray, parts: list[str]):
        if len(self.keys) + len(keys) > MAX_KNOWN:
            self.clear()
        ids = [e.ids for e in _tokenizer(self.path).encode_batch_fast(parts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.n, n)))


@cache
def _known(path: str) -> _Known:
    return _Known(path)


def _parts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's parts, and per text whether the tables do not settle it."""
    n = len(offs) - 1
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    b = buf[lead]
    pad = np.concatenate([buf, np.zeros(1, np.uint8)])
    cp = b.astype(np.int32)
    two = (b >= 0xC0) & (b < 0xE0)
    cp[two] = ((b[two].astype(np.int32) & 31) << 6) | (pad[lead[two] + 1].astype(np.int32) & 63)
    cls = np.full(len(lead), _ASK, np.uint8)
    ok = (b < 0xE0) & (cp < 0x250)
    cls[ok] = _classes()[cp[ok]]
    first = np.searchsorted(lead, offs)  # first character of each text
    ask = np.zeros(n, bool)
    odd = np.flatnonzero(cls == _ASK)
    ask[np.searchsorted(first, odd, "right") - 1] = True
    begin = np.zeros(len(lead) + 1, bool)
    begin[first] = True  # also marks the end
    start = begin[:-1].copy()
    start[1:] |= cls[1:] != cls[:-1]
    space = cls == _SPACE
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~begin[1:-1])
    start[before] = True
    start[before + 1] = cp[before] != 0x20
    return lead[start], ask


def encode(texts: pa.Array, path: str):
    """For slices of a column: (from, to, ids end to end, n+1 offsets)."""
    buf, offs = utf8(texts)
    known, added = _known(path), _holds_added(texts, path)
    for i, j in slices(offs):
        part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ask = _parts(part, own) if len(part) else (np.zeros(0, np.int64), np.zeros(j - i, bool))
        ask |= added[i:j]
        doc = np.searchsorted(own, starts, "right") - 1
        ends = np.append(starts[1:], len(part))
        use = ~ask[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        keys = Prefix(part).of(starts, ends)
        uniq, back = np.unique(keys, return_inverse=True)
        where = np.searchsorted(known.keys, uniq)
        new = np.ones(len(uniq), bool) if not len(known.keys) else known.keys[np.minimum(where, len(known.keys) - 1)] != uniq
        if new.any():
            if len(known.keys) + int(new.sum()) > MAX_KNOWN:
                known.clear()
                new[:] = True
            some = np.zeros(len(uniq), np.int64)
            some[back] = np.arange(len(keys))
            data = part.tobytes()
            known.add(uniq[new], [data[a:z].decode() for a, z in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)])
            where = np.searchsorted(known.keys, uniq)
        n, at = known.n[where][back], known.at[where][back]
        total = int(n.sum())
        ids = known.pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)]
        size = np.bincount(doc, n, j - i).astype(np.int64)
        if ask.any():
            whole = {d: np.array(_tokenizer(path).encode(part[own[d] : own[d + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(ask).tolist()}
            lows = np.concatenate([[0], np.cumsum(size)])
            ids = np.concatenate([whole.get(d, ids[lows[d] : lows[d + 1]]) for d in range(j - i)])
            for d, x in whole.items():
                size[d] = len(x)
        yield i, j, ids, np.concatenate([[0], np.cumsum(size)])
