"""Removal of byte strings that repeat in the corpus, by a distributed suffix merge sort.

A `width`-byte string that starts in two places holds, in both, the same anchor: the
leftmost `ANCHOR`-byte gram of least hash among its grams. So only suffixes at anchors are
sorted, about one in sixty, and of these only such whose first gram occurs twice (a count
over the corpus, returned as a bitmap of fixed size). Each task sorts its suffixes, of
`width` bytes at most, into runs by sampled splitters and front-codes them: every suffix is
sent as the length it shares with the one before and the rest. The receiver merges the runs
with a loser tree that knows the common prefixes with the last winner and compares only
bytes beyond them. The merged order's common prefixes, and the bytes to the left of each
anchor, tell exactly which strings around it occur elsewhere.

Texts are known by their digest: equal texts have equal results, and one of 200 bytes or
more with a copy goes as a whole. The splitters are whole first grams of sampled occurrences,
so parts are even unless one gram alone has more occurrences than a part; those with equal
surroundings are one entry of a run, those with different ones meet in one task. Memory of a
task: a slice of text, a run of ENTRIES suffixes, or a part. The bitmap grows with the repeated
grams up to MOST_BITS; beyond, more suffixes are exchanged in vain, but results stay the same.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, named, others, ranges_for, safe, shape_of, stash
from .words import Prefix, mix, slices, utf8

ANCHOR = 64
TILE = 1 << 19
MOST_BITS = 1 << 28
ENTRIES = 1 << 15  # suffixes of a run
PARTS_A_TASK = 4
SAMPLED = 32  # first grams collected for each part, to choose splitters


def anchors(part: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows inside texts, and the hashes of their grams."""
    found, hashes = [], []
    span = width - ANCHOR + 1  # grams in a window
    for lo in range(0, max(0, len(part) - width + 1), TILE):
        hi = min(lo + TILE, len(part) - width + 1)  # windows that start in [lo, hi)
        tile = part[lo : hi + width - 1]
        n = len(tile) - ANCHOR + 1
        at = np.arange(n)
        gram = Prefix(tile).of(at, at + ANCHOR)
        packed = (gram >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        blocks = -(-n // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = packed
        table = padded.reshape(blocks, span)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(hi - lo)
        least = np.minimum(back[starts], ahead[starts + span - 1])
        doc = np.searchsorted(own, starts + lo, "right") - 1
        inside = starts + lo + width <= own[doc + 1]
        pos = np.unique((least[inside] & np.uint64((1 << 24) - 1)).astype(np.int64))
        found.append(pos + lo)
        hashes.append(gram[pos])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(hashes)[first]


def _grams(width: int):
    """(key, seen): gram hashes of anchors and their occurrences in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, own, _ in _new_texts(batch.column("text"), seen):
                _, keys = anchors(part, own, width)
                uniq, count = np.unique(keys, return_counts=True)
                yield pa.record_batch([pa.array(uniq.view(np.int64)), pa.array(count)], names=["key", "seen"])

    return run


def _wanted(keys: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    b = keys % np.uint64(8 * len(mask))
    return (mask[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _leads(width: int, bits, share: float):
    """(lead): first grams of a share of the repeated anchors, by a hash of gram and place."""
    below = np.uint64(int(min(1.0, share) * (2**53 - 1)) << 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, own, _ in _new_texts(batch.column("text"), seen):
                pos, keys = anchors(part, own, width)
                with np.errstate(over="ignore"):
                    take = _wanted(keys, bits.value) & (mix(keys + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) <= below)
                yield pa.record_batch([pa.array([part[p : p + ANCHOR].tobytes() for p in pos[take].tolist()], pa.binary())], names=["lead"])

    return run


def _new_texts(column, seen: set[bytes]):
    """Slices of texts whose digest this task has not met: (bytes, offsets, digests)."""
    buf, offs = utf8(column)
    for i, j in slices(offs, TILE):
        data = buf[offs[i] : offs[j]].tobytes()
        base, keep, digests = int(offs[i]), [], []
        for d in range(i, j):
            digest = hashlib.md5(data[offs[d] - base : offs[d + 1] - base]).digest()
            if digest not in seen:
                seen.add(digest)
                keep.append(d)
                digests.append(digest)
        if len(keep) == j - i:
            yield buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], digests
        elif keep:
            yield np.concatenate([buf[offs[d] : offs[d + 1]] for d in keep]), np.concatenate([[0], np.cumsum([offs[d + 1] - offs[d] for d in keep])]), digests


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree."""
    most = min(len(a), len(b))
    h = known
    while h < most and a[h : h + 32] == b[h : h + 32]:
        h += 32
    while h < most and a[h] == b[h]:
        h += 1
    return min(h, most)


def front_code(sorted_suffixes: list[bytes]) -> list[tuple[int, bytes]]:
    """(shared length with the one before, rest) of each suffix."""
    out, before = [], b""
    for s in sorted_suffixes:
        h = common(before, s, 0)
        out.append((h, s[h:]))
        before = s
    return out


def _runs(width: int, bits, splitters):
    """Front-coded sorted runs: (part, run, seq, shared, rest, left, refs)."""
    reach = width - ANCHOR
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def coded(entries: dict, cuts: list[bytes], run_id: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for part, group in groupby(sorted(entries), lambda e: bisect_right(cuts, e[0][:ANCHOR])):
            mine = list(group)
            for seq, ((h, rest), e) in enumerate(zip(front_code([x for x, _ in mine]), mine, strict=True)):
                for c, v in zip(cols, (part, run_id, seq, h, rest, e[1], b"".join(entries[e])), strict=True):
                    c.append(v)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "run", "seq", "shared", "rest", "left", "refs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, cuts, seen = bits.value, splitters.value, set()
        run_id = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        entries: dict[tuple[bytes, bytes], list[bytes]] = {}
        for batch in batches:
            for part, own, digests in _new_texts(batch.column("text"), seen):
                pos, keys = anchors(part, own, width)
                pos = pos[_wanted(keys, mask)]
                data, doc = part.tobytes(), np.searchsorted(own, pos, "right") - 1
                for p, d, lo, hi in zip(pos.tolist(), doc.tolist(), own[doc].tolist(), own[doc + 1].tolist(), strict=True):
                    entries.setdefault((data[p : min(p + width, hi)], data[max(lo, p - reach) : p]), []).append(digests[d] + (p - lo).to_bytes(8, "big"))
                    if len(entries) >= ENTRIES:
                        yield coded(entries, cuts, run_id)
                        entries, run_id = {}, run_id + 1
        if entries:
            yield coded(entries, cuts, run_id)

    return run


def merge_runs(runs: list[list[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (string, shared length with its predecessor in the run, payload).

    Yields (string, shared length with the one yielded before, payload). Every contender in
    the loser tree keeps its common prefix with the last string yielded; the longer one is
    the smaller string, and only for equal lengths are bytes beyond it compared.
    """
    k = len(runs)
    if not k:
        return
    size = 1 << (k - 1).bit_length() if k > 1 else 1
    at = [0] * size
    done = (None, -1, None)
    head = [(runs[i][0] if i < k and runs[i] else done) for i in range(size)]
    lcp = [0 if h[0] is not None else -1 for h in head]  # with the last string yielded

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's common prefix is set to the one with the winner."""
        x, y = head[a][0], head[b][0]
        if y is None or x is None:
            return x is not None or y is None and a < b
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]  # the loser shares with the winner what it shares with the last
        h = common(x, y, lcp[a])
        first = (x[h : h + 1], a) < (y[h : h + 1], b)
        lcp[b if first else a] = h
        return first

    tree = [-1] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    winner = build(1) if size > 1 else 0
    while head[winner][0] is not None:
        yield head[winner][0], lcp[winner], head[winner][2]
        at[winner] += 1
        run = runs[winner]
        if at[winner] < len(run):
            head[winner] = run[at[winner]]
            lcp[winner] = head[winner][1]
        else:
            head[winner], lcp[winner] = done, -1
        node = (winner + size) >> 1
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node >>= 1


def _spans_of(group: list[tuple[bytes, int, bytes, list[bytes]]], width: int):
    """(ref, start, end) of repeated strings around anchors; group: (suffix, shared with the
    one before, left bytes, refs) in merged order, whole sets of equal first grams."""
    reach = width - ANCHOR
    n = len(group)
    shared = np.array([g[1] for g in group])
    right = np.array([len(g[0]) for g in group])
    left = np.array([len(g[2]) for g in group])
    many = np.array([len(g[3]) > 1 for g in group])
    flat = np.zeros((n, reach), np.uint8)
    for i, g in enumerate(group):
        if g[2]:
            flat[i, : len(g[2])] = np.frombuffer(g[2], np.uint8)[::-1]
    dup = np.zeros((n, reach + 1), bool)
    h = np.zeros(n, np.uint64)
    for o in range(reach + 1):
        if o:
            with np.errstate(over="ignore"):
                h = mix(h * np.uint64(0x100000001B3) + flat[:, o - 1].astype(np.uint64) + np.uint64(o))
        ok = (left >= o) & (right >= width - o)
        if not ok.any():
            continue
        at = np.flatnonzero(ok)
        seg = np.cumsum(shared < width - o)[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix(seg * np.uint64(0x9E3779B97F4A7C15) ^ h[at])
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        dup[at[order[same[1:] | same[:-1]]], o] = True
        dup[at[many[at]], o] = True
    for i in np.flatnonzero(dup.any(axis=1)).tolist():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], dup[i].astype(np.int8), [0]])))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # offsets a .. z-1
            for ref in group[i][3]:
                p = int.from_bytes(ref[16:], "big")
                yield ref[:16], p - (z - 1), p - a + width


def _merge(width: int):
    """Merge the runs of a part and give (digest, start, end) of what repeats."""

    def flush(rows):
        runs: dict[int, list] = {}
        for run, shared, rest, left, refs in rows:
            own = runs.setdefault(run, [])
            own.append(((own[-1][0][:shared] if own else b"") + rest, shared, (left, refs)))
        found: list = []
        group: list = []
        for s, shared, (left, refs) in merge_runs(list(runs.values())):
            if shared < ANCHOR and len(group) > 4096:
                found += _spans_of(_alike(group), width)
                group = []
            group.append((s, shared if group else 0, left, [refs[i : i + 24] for i in range(0, len(refs), 24)]))
        if group:
            found += _spans_of(_alike(group), width)
        return found

    def _alike(group):
        """Join entries of equal suffix and equal left bytes; drop grams that stand alone."""
        out: list = []
        i = 0
        while i < len(group):
            j = i + 1
            while j < len(group) and group[j][1] >= ANCHOR:
                j += 1
            if j - i == 1:
                s, h, left, refs = group[i]
                if len(set(refs)) > 1:
                    out.append((s, 0, left, list(set(refs))))
            else:
                k = i
                low = 0
                while k < j:
                    e = k + 1
                    while e < j and group[e][0] == group[k][0]:
                        e += 1
                    by_left: dict[bytes, set] = {}
                    for _, _, left, refs in group[k:e]:
                        by_left.setdefault(left, set()).update(refs)
                    low = group[k][1] if k > i else 0
                    for left, refs in by_left.items():
                        out.append((group[k][0], low, left, list(refs)))
                        low = len(group[k][0])
                    k = e
            i = j
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "shared", "rest", "left", "refs")), strict=True):
                if p != part:
                    yield from _spans_batches(flush(rows))
                    part, rows = p, []
                rows.append(row)
        yield from _spans_batches(flush(rows))

    return run


def _spans_batches(found: list):
    for lo in range(0, len(found), 50_000):
        d, a, z = zip(*found[lo : lo + 50_000], strict=True)
        yield pa.record_batch([pa.array(d, pa.binary()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["digest", "start", "end"])


def repeated_spans(docs: DataFrame, width: int = 200, text_col: str = "text") -> DataFrame:
    """Rows (digest, whole, spans): what repeats in the texts of this MD5 digest.

    whole: the text has a copy and at least `width` bytes, so all of it repeats; spans: byte
    ranges [start, end), maybe overlapping. Texts without repeats have no row.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    with Scratch() as own:
        grams = base.mapInArrow(_grams(width), "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen"))
        # a gram of a text with copies may be counted once a task: then it is exchanged in vain
        twice = stash(grams.where("seen > 1"))
        n, total = twice.agg(F.count("*"), F.sum("seen")).head()
        bits = spark.sparkContext.broadcast(_bitmap(twice, min(MOST_BITS, 1 << max(20, (16 * n).bit_length()))))
        parts = PARTS_A_TASK * ranges_for(spark)
        # about SAMPLED grams a part, from more texts than one in 64 grams asks for
        share = min(1.0, SAMPLED * parts / max(total or 1, 1))
        texts = min(1.0, 64 * share)
        some = base.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(texts * (1 << 20)) + 1)
        leads = some.mapInArrow(_leads(width, bits, share / texts), "lead binary").toArrow()
        leads = sorted(leads.column("lead").to_pylist())
        splitters = spark.sparkContext.broadcast(sorted({leads[i * len(leads) // parts] for i in range(1, parts)} if leads else ()))
        runs = base.mapInArrow(_runs(width, bits, splitters), "part int, run long, seq int, shared int, rest binary, left binary, refs binary")
        merged = runs.repartition(parts, "part").sortWithinPartitions("part", "run", "seq").mapInArrow(_merge(width), "digest binary, start long, end long")
        spans = merged.distinct().groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        copies = base.where(F.octet_length("text") >= width).groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
        out = copies.select("digest", F.lit(True).alias("whole")).join(spans, "digest", "full")
        found = stash(out.select("digest", F.coalesce("whole", F.lit(False)).alias("whole"), "spans"))
        own.keep(found)
    return found


def _bitmap(keys: DataFrame, size: int) -> np.ndarray:
    """Bytes of a bitmap of `size` bits (a power of two) with the bit of each key set; built in Spark."""
    b = F.expr(f"pmod(key, {size}) + 1")
    words = keys.select(b.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("w")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m"))
    mask = np.zeros(size // 8, np.uint8)
    for w, m in words.toLocalIterator():  # at most size / 2**15 rows of 4 KB
        mask[(w - 1) * len(m) : w * len(m)] |= np.frombuffer(bytes(m), np.uint8)
    return mask


def _cut(names: list[str]):
    """Rows (carried columns, whole, spans, text) without what repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *carried, whole, spans, texts = batch.columns
            buf, offs = utf8(texts)
            whole, spans = whole.to_pylist(), spans.to_pylist()
            size, removed, runs, sha, kept = [], [], [], [], []
            for d in range(batch.num_rows):
                data = buf[offs[d] : offs[d + 1]].tobytes()
                ranges = merged_ranges([(0, len(data))] if whole[d] else [(s["start"], s["end"]) for s in spans[d] or []])
                out, done = [], 0
                for a, z in ranges:
                    out.append(data[done:a])
                    done = z
                left = b"".join([*out, data[done:]])
                size.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(len(ranges))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.record_batch([*carried, *(pa.array(v, pa.int64()) for v in (size, removed, runs)), pa.array(sha), pa.array(kept, pa.binary())], names=names)

    return run


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def without_repeats(docs: DataFrame, width: int = 200, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text and namesakes) and n_bytes, n_removed, n_spans,
    kept_sha256, kept (the bytes that stay; a cut may fall inside a character).

    Null texts are empty. Texts under `width` bytes never lose a byte. Spans that touch are one.
    Repeated rows are copies of each other. Other columns may have any name.
    """
    stats = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}
    carry = others(docs, text_col, *stats) if carry is None else carry
    found = repeated_spans(docs, width, text_col)
    base = docs.select(*safe(carry), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    joined = base.withColumn("digest", F.unhex(F.md5("text"))).join(found, "digest", "left")
    joined = joined.select(*[f"c{i}" for i in range(len(carry))], F.coalesce("whole", F.lit(False)).alias("whole"), "spans", "text")
    shape = shape_of(docs, carry, stats)
    return joined.mapInArrow(_cut(shape.names), shape)
