"""Quality rules: text statistics and learned decision lists.

Statistics are computed over whole texts with array operations. A decision list is learned
by sequential covering: a conjunction of thresholds is grown condition by condition for the
best information gain on two thirds of the labelled rows, pruned on the other third, kept if
it is precise enough on both, and the rows it covers are taken out. The list becomes one
ordered CASE expression; no model object and no Python take part in applying it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named, others, shape_of, stash, text_rows
from .words import SPACE, Prefix, distinct_sets, mix, shingle_hashes, slices, utf8, word_hashes, word_spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_bytes")
#: Threshold features, as expressions over the statistics; all lie in bounded ranges.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}
MAX_LABELLED = 20_000  # rows that a list is learned from, at most


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL = _flags("#*$%&|<>")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _flags("0123456789")
_MARK = _flags("!?~^=_+")


def text_stats(texts: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """For slices of a column: (from, to, statistic by name)."""
    buf, offs = utf8(texts)
    for i, j in slices(offs):
        part, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        starts, ends, first = word_spans(part, own)

        def per(flags: np.ndarray, own=own) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[own[1:]] - total[own[:-1]]

        solid = ~SPACE[part] if len(part) else np.zeros(0, bool)
        out = {"n_words": np.diff(first), "word_chars": per(solid & ((part & 0xC0) != 0x80)), "n_bytes": np.diff(own)}
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            out[name] = per(table[part])
        # lines with a word, and those equal to an earlier one
        feeds = np.flatnonzero(part == 0x0A)
        lo = np.concatenate([own[:-1], feeds + 1])
        from_doc = np.concatenate([np.arange(n), np.searchsorted(own, feeds, "right") - 1])
        by_doc = np.lexsort((lo, from_doc))
        lo, from_doc = lo[by_doc], from_doc[by_doc]
        hi = np.append(lo[1:] - 1, len(part))
        last = np.append(from_doc[1:] != from_doc[:-1], True)
        hi[last] = own[from_doc[last] + 1]
        filled = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
        some = filled[hi] > filled[lo]
        lo, hi, from_doc = lo[some], hi[some], from_doc[some]
        lines = np.bincount(from_doc, minlength=n)
        _, at = distinct_sets(Prefix(part).of(lo, hi) if len(lo) else np.zeros(0, np.uint64), from_doc, n)
        out["n_lines"], out["n_dup_lines"] = lines, lines - np.diff(at)
        # words in three-word windows that occur again in the text
        h, doc = shingle_hashes(word_hashes(part, starts, ends), first, 3)
        full = np.diff(first)[doc] >= 3
        h, doc = h[full], doc[full]
        with np.errstate(over="ignore"):
            _, back, count = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        again = count[back] > 1
        windows = np.maximum(np.diff(first) - 2, 0)
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][doc]
        begin = begin[again]
        covered = np.zeros(len(starts) + 1, np.int64)
        for k in range(3):
            covered[begin + k] = 1
        total = np.concatenate([[0], np.cumsum(covered)])
        out["n_repeat_words"] = total[first[1:]] - total[first[:-1]]
        yield i, j, out


def _stats_of(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *carried, texts = batch.columns
            for i, j, stats in text_stats(texts):
                yield pa.record_batch([c.slice(i, j - i) for c in carried] + [pa.array(stats[s].astype(np.int64)) for s in STATS], names=names)

    return run


def with_stats(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text and namesakes) and the statistics STATS, for every row.

    Null and empty texts, and texts of white space, have 0 in every count. Each row counts by
    itself, repeated rows alike; other columns may have any name.
    """
    carry = others(docs, text_col, *STATS) if carry is None else carry
    shape = shape_of(docs, carry, dict.fromkeys(STATS, "long"))
    return text_rows(docs, text_col, carry).mapInArrow(_stats_of(shape.names), shape)


Rule = list[tuple[str, str, float]]  # a conjunction of (feature, "<=" or ">=", threshold)


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for f, op, t in rule:
        hit &= (x[f] <= t) if op == "<=" else (x[f] >= t)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the condition of best FOIL gain until no good row is covered."""
    rule: Rule = []
    hit = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p or not n:
            break
        best, cond = 1e-9, None
        for f in x:
            v, y = x[f][hit], bad[hit]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])  # between two values
            if not len(cut):
                continue
            up, down = np.cumsum(y), np.cumsum(~y)
            for op in ("<=", ">="):
                a = up[cut] if op == "<=" else p - up[cut]
                b = down[cut] if op == "<=" else n - down[cut]
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, cond = float(gain[k]), (f, op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if cond is None:
            break
        rule.append(cond)
        hit &= _covers([cond], x, len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.97, min_cover: int = 8, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """An ordered list of rules for `bad` rows; fold 2 of 0..2 prunes. Deterministic."""
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (left & bad).sum() >= min_cover:
        g, q = left & (fold != 2), left & (fold == 2)
        rule = _grow({f: v[g] for f, v in x.items()}, bad[g], most_conditions)
        if not rule:
            break
        xq, yq = {f: v[q] for f, v in x.items()}, bad[q]

        def worth(r: Rule, xq=xq, yq=yq) -> float:
            hit = _covers(r, xq, len(yq))
            p, n = int((hit & yq).sum()), int((hit & ~yq).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, len(bad)) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_cover or p / (p + n) < precision or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


SPACE_OF_HASHES = 1 << 30


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, label: str = "quality") -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(features, bad, fold) of the `most` labelled rows of least hash of the id, or all if fewer.

    Rows equal in id, features and label count once. Both sides are cut by a threshold of the
    hash, set from the number of labels, before they meet; it is doubled at least while it
    leaves too few. So the join and what reaches the driver stay near `most` rows.
    """
    named_stats = stats.selectExpr("doc_id", *(f"cast({e} as double) as `{f}`" for f, e in FEATURES.items()))
    known = labels.select("doc_id", named(label).alias("is_good")).where("doc_id is not null and is_good is not null")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(SPACE_OF_HASHES))
    total, below = known.count(), SPACE_OF_HASHES
    if total > most:
        below = int(SPACE_OF_HASHES * 1.1 * most / total) + 1
    while True:
        near = h < min(below, SPACE_OF_HASHES)
        rows = named_stats.where(near).join(known.where(near), "doc_id").distinct()
        n = rows.count() if below < SPACE_OF_HASHES else most
        if n >= most:
            break
        below = int(below * max(2.0, 1.1 * most / max(n, 1)))
    pdf = rows.orderBy(h, "doc_id", *FEATURES, "is_good").limit(most).toPandas()
    x = {f: pdf[f].to_numpy(float) for f in FEATURES}
    fold = np.array([crc32(str(d).encode()) % 3 for d in pdf["doc_id"]], int)
    return x, pdf["is_good"].to_numpy(int) == 0, fold


def verdict(rules: list[Rule]) -> Column:
    """false where a rule fires, true else: one ordered CASE expression over the statistics."""
    out = None
    for rule in rules:
        test = F.expr(" and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """(rows (doc_id, statistics, base_failed, kept), the rules learned).

    Without usable labels no rule is learned and only the base test decides. Rows with null
    ids are judged, but never learned from; repeated rows are judged alike.
    """
    stats = stash(with_stats(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))))
    x, bad, fold = labelled_sample(stats, labels, most, label)
    rules = learn(x, bad, fold) if len(bad) else []
    failed = F.expr(BASE_FAILED)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)), rules
