"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Candidates are maximal runs of token characters. Over each run a window of `WINDOW`
characters slides; the counts of its characters are updated by one in and one out, and its
Shannon entropy follows from them in the same step. A run is reported if the highest window
reaches the limit of its character class, unless an allow-list pattern suppresses it; where
fixed patterns cover a part of a run, what is left of it is scanned. Whole texts are scanned;
texts that can hold neither are passed over by array tests on their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import others, shape_of, text_rows
from .words import utf8

WINDOW = 20
# Bits a window of WINDOW characters must reach, by character class. Of 400 random strings of
# 32 letters of both cases over nineteen in twenty reach 3.87; long identifiers stay below 3.83.
LIMITS = {"hex": 3.0, "mixed": 3.6, "letters": 3.87}
# Strings that look random and are not secret: runs of one character, counting, placeholders.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted",
    r"(?i)0123456789|1234567890|abcdefghij|qwertyuiop",
    r"(.)\1{7}",
)
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def peak_entropy(s: str, window: int = WINDOW) -> float:
    """Highest Shannon entropy (bits a character) of any window of `s`, by incremental counts."""
    window = min(window, len(s))
    if not window:
        return 0.0
    part = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total = best = 0.0  # total: sum of c * log2(c)
    for i, c in enumerate(s):
        if i >= window:
            old = s[i - window]
            count[old] -= 1
            total += part[count[old]] - part[count[old] + 1]
        count[c] = count.get(c, 0) + 1
        total += part[count[c]] - part[count[c] - 1]
        if i >= window - 1:
            best = max(best, log2(window) - total / window)
    return best


def char_class(s: str) -> str | None:
    """hex, mixed (letters and digits), letters (of both cases), or None.

    Digits alone are numbers, and letters of one case are too like words, however many.
    """
    if not re.search(r"[A-Za-z]", s):
        return None
    if re.search(r"[0-9]", s):
        return "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else "mixed"
    return "letters" if re.search(r"[a-z]", s) and re.search(r"[A-Z]", s) else None


def scan_text(text: str, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[int, int, str, int]]:
    """Spans (start, end, kind, start of the secret value), by start and then kind."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]
    base = sorted((a, z) for a, z, _, _ in found)
    for m in _RUN.finditer(text):
        for start, end in _uncovered(m.start(), m.end(), base):
            s = text[start:end]
            kind = char_class(s)
            if kind and peak_entropy(s) >= LIMITS[kind] and not any(re.search(p, s) for p in allowed):
                found.append((start, end, "entropy", start))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of start..end outside of the sorted spans that hold a window."""
    for a, z in spans:
        if z <= start:
            continue
        if a >= end:
            break
        if a - start >= WINDOW:
            yield start, a
        start = max(start, z)
    if end - start >= WINDOW:
        yield start, end


def _suspects(texts: pa.Array) -> np.ndarray:
    """Texts that may hold a span: a keyword, or a long run of token characters."""
    buf, offs = utf8(texts)
    hit = pc.fill_null(pc.match_substring_regex(texts, r"(?i)password|passwd|secret|token|api_?key|AKIA"), False).to_numpy(zero_copy_only=False).copy()
    for lo in range(0, len(texts), 512):
        hi = min(lo + 512, len(texts))
        part, own = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if not len(part):
            continue
        run = _RUN_BYTE[part]
        joined = run[:-1] & run[1:]
        cuts = own[(own > 0) & (own < len(part))]
        joined[cuts - 1] = False  # a run ends with its text
        a = np.flatnonzero(run & ~np.concatenate([[False], joined]))
        z = np.flatnonzero(run & ~np.concatenate([joined, [False]])) + 1
        long = z - a >= WINDOW
        at = np.searchsorted(own, a[long], "right") - 1
        hit[lo + at] = True
    return hit


def _scan(allowed: tuple[str, ...], redact: str | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value_start", pa.int64())]))
        for batch in batches:
            *carried, texts = batch.columns
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            spans: list = [[]] * len(texts)
            new = {}
            for d in np.flatnonzero(_suspects(texts)).tolist():
                text = texts[d].as_py()
                if text is None:
                    continue
                found = scan_text(text, allowed)
                spans[d] = [dict(zip(("start", "end", "kind", "value_start"), f, strict=True)) for f in found]
                if redact is not None and found:
                    new[d] = blanked(text, found, redact)
            cols = carried
            if redact is not None:
                if new:
                    at = np.zeros(len(texts), bool)
                    at[list(new)] = True
                    texts = pc.replace_with_mask(texts, pa.array(at), pa.array([new[d] for d in sorted(new)], texts.type))
                cols.append(texts)
            yield pa.record_batch([*cols, pa.array(spans, kind)], names=names)

    return run


def blanked(text: str, spans: list[tuple[int, int, str, int]], by: str) -> str:
    """`text` with each secret value replaced; overlapping values become one."""
    out, done = [], 0
    for start, end in sorted((v, e) for _, e, _, v in spans):
        if end <= done:
            continue
        if start >= done:
            out += [text[done:start], by]
        done = end
    return "".join(out) + text[done:]


def scan(docs: DataFrame, text_col: str = "text", allowed: tuple[str, ...] = ALLOWED, redact: str | None = None, spans_col: str = "secret_spans", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text and a namesake) and `spans_col`, for every row.

    Spans have code point positions, end exclusive. With `redact`, the text comes along with
    every secret value replaced. Null and empty texts have no spans (a null stays null).
    Each row is scanned by itself, repeated rows alike; other columns may have any name.
    """
    carry = others(docs, text_col, spans_col) if carry is None else carry
    spans = "array<struct<start:long,end:long,kind:string,value_start:long>>"
    more = ({text_col: "string"} if redact is not None else {}) | {spans_col: spans}
    shape = shape_of(docs, carry, more)
    return text_rows(docs, text_col, carry).mapInArrow(_scan(allowed, redact, shape.names), shape)


def joined_spans(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined in their order."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform(filter({spans}, s -> s.kind in ({listed})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
