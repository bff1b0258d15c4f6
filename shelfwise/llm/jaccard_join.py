"""N-gram Jaccard join by a blocked sparse product of documents and word shingles.

Documents with the same shingle set are one class. A class enters only the columns of its
prefix, the rarest shingles: of them a partner at the wanted similarity must share `need`,
a twentieth of the set or `SHARED`. Columns met by one class, and classes with too few columns
left, drop out in turn. Pairs are counted over the columns of up to `SMALL` classes; a pair
that reaches its need with these and what longer columns could add, and classes that could
reach it by longer columns alone, make groups. A group's incidence matrix is multiplied with
its transpose in blocks of `BLOCK` classes, column by column, accumulating overlap counts
and the last shared position. Pairs below the size-derived bounds are discarded, the others
compared by their whole sets, most overlaps first, and passed over once known to be
connected.

Any one order of shingles gives an exact prefix filter; ours takes rare ones first by a
fixed-size table of counts (`BUCKETS`), so that common passages come last. Memory of a task:
a slice of text or a pair of blocks; broadcast: the table of counts and a bitmap, both of
fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, components, fresh, named, ranges_for, stash
from .words import text_shingles

BUCKETS = 1 << 20
BITS = 1 << 24
BLOCK = 1536
WEIGHT = 1 << 20  # shingles of a block
HOT = 1 << 14  # classes in a column beyond which its rows are salted
SHARED = 4
SMALL = 32  # classes in a column whose pairs are counted one by one
_FREQ_SHIFT = 48


def _need(x, y, percent):
    """Least overlap of sets of sizes x and y with 100 * I >= percent * U."""
    return (percent * (x + y) + 99 + percent) // (100 + percent)


def _meet(n, percent):
    """Prefix columns that a set of n shares with any partner, or a pair by its smaller set."""
    return np.minimum(np.maximum(SHARED, n // 20), (percent * n + 99) // 100)


def _describe(k: int, lower: bool):
    """Per row: position-preserving set size and fingerprint; besides, local shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(BUCKETS, np.int64), set()
        for batch in batches:
            for i, j, sets, at, k1, k2 in _prints(batch.column("text"), k, lower):
                n = np.diff(at)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(k1), pa.array(k2), pa.nulls(j - i, pa.int64())], names=["doc_id", "n", "k1", "k2", "bucket"])
                new = []
                for d, key in enumerate(k1.tolist()):
                    if n[d] and key not in seen:
                        seen.add(key)
                        new.append(d)
                if new:
                    h = np.concatenate([sets[at[d] : at[d + 1]] for d in new])
                    h.sort()
                    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    count = np.diff(np.append(edge, len(h)))
                    often = count > 1
                    np.add.at(table, (h[edge[often]] >> np.uint64(24)) % np.uint64(BUCKETS), count[often])
        hit = np.flatnonzero(table)
        for lo in range(0, len(hit), 100_000):
            b = hit[lo : lo + 100_000]
            none = pa.nulls(len(b), pa.int64())
            yield pa.record_batch([none, pa.array(table[b]), none, none, pa.array(b)], names=["doc_id", "n", "k1", "k2", "bucket"])

    return run


def _prints(column, k: int, lower: bool, twins: dict | None = None):
    from .words import set_prints

    for i, j, sets, at in text_shingles(column, k, lower):
        k1, k2 = set_prints(sets, at)
        if twins:
            k1 = np.array([twins.get(key, key[0]) for key in zip(k1.tolist(), k2.tolist(), strict=True)], np.int64)
        yield i, j, sets, at, k1, k2


def _prefixes(k: int, lower: bool, percent: int, counts, twins: dict):
    """Rows (col, salt, k1, n, pos): the prefix columns of each class met in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for batch in batches:
            for _, _, sets, at, k1, _ in _prints(batch.column("text"), k, lower, twins):
                freq = table[(sets >> np.uint64(24)) % np.uint64(BUCKETS)]
                key = (freq.astype(np.uint64) << np.uint64(_FREQ_SHIFT)) | (sets >> np.uint64(64 - _FREQ_SHIFT))
                n = np.diff(at)
                take = np.where(n > 0, n - (percent * n + 99) // 100 + _meet(n, percent), 0)
                for d, name in enumerate(k1.tolist()):
                    if name in seen:
                        take[d] = 0
                    elif take[d]:
                        seen.add(name)
                        key[at[d] : at[d + 1]].sort()
                doc = np.repeat(np.arange(len(n)), take)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
                col = key[at[doc] + pos]
                salts = np.maximum(1, (_count_of(col >> np.uint64(_FREQ_SHIFT)) + HOT - 1) // HOT)
                salt = (k1[doc].view(np.uint64) % salts.astype(np.uint64)).astype(np.int32) + np.where(salts > 1, 1, 0).astype(np.int32)
                yield pa.record_batch([pa.array(col.view(np.int64)), pa.array(salt), pa.array(k1[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["col", "salt", "k1", "n", "pos"])

    return run


def _level_of(count: np.ndarray) -> np.ndarray:
    """Counts as 16-bit levels: 16 steps an octave, so that levels stay ordered and small."""
    return np.floor(16 * np.log2(np.maximum(count, 0) + 1.0)).astype(np.uint64)


def _count_of(level: np.ndarray) -> np.ndarray:
    return np.floor(2.0 ** (level.astype(np.float64) / 16)).astype(np.int64) - 1


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (col, salt, k1), those of columns with two classes, each class once."""
    names = ["col", "salt", "k1", "n", "pos"]
    rest = None

    def chosen(x):
        col, salt, k1 = x[0], x[1], x[2]
        new = np.concatenate([[True], (col[1:] != col[:-1]) | (salt[1:] != salt[:-1])])
        first = new | np.concatenate([[True], k1[1:] != k1[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group, first)[group] > 1
        keep = first & (many | (salt > 0))  # a salted column is a hot one
        return pa.record_batch([pa.array(x[i][keep]) for i in (0, 2, 3, 4)], names=["col", "k1", "n", "pos"])

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            now = [np.concatenate([a, b]) for a, b in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        cut = len(now[0]) - 1
        while cut and now[0][cut] == now[0][cut - 1] and now[1][cut] == now[1][cut - 1]:
            cut -= 1
        if cut:
            yield chosen([x[:cut] for x in now])
        rest = [x[cut:] for x in now]
    if rest is not None and len(rest[0]):
        yield chosen(rest)


def _small_pairs(percent: int):
    """(a, b, need, spare) for pairs in columns of rows sorted by (col, n, k1): columns both
    must share, and how many longer columns they have in common at most."""

    def pairs(x):
        col, n, k1, pos, long = x
        n = n.astype(np.int64)
        out = [[], [], [], []]
        for d in range(1, SMALL):
            if len(col) <= d:
                break
            u, v = slice(None, -d), slice(d, None)
            ok = (col[u] == col[v]) & (100 * n[u] >= percent * n[v])  # rows come by size
            i, j = pos[u], pos[v]
            ok &= np.minimum(i, j) + np.minimum(n[u] - i, n[v] - j) >= _need(n[u], n[v], percent)
            if ok.any():
                a, b = k1[u][ok], k1[v][ok]
                for o, c in zip(out, (np.minimum(a, b), np.maximum(a, b), _meet(n[u][ok], percent), np.minimum(long[u][ok], long[v][ok])), strict=True):
                    o.append(c.astype(np.int64))
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["a", "b", "need", "spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("col", "n", "k1", "pos", "long")]
            if rest is not None:
                now = [np.concatenate([a, b]) for a, b in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            yield from pairs([x[:cut] for x in now])
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield from pairs(rest)

    return run


def _active_sets(k: int, lower: bool, bits, twins: dict):
    """Shingle sets of the classes whose bit is set: (k1, k2, n, shingles as bytes)."""

    def run(batches):
        mask, seen = bits.value, set()
        for batch in batches:
            for _, _, sets, at, k1, k2 in _prints(batch.column("text"), k, lower, twins):
                b = k1.view(np.uint64) % np.uint64(BITS)
                hit = (mask[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
                rows = []
                for d in np.flatnonzero((hit == 1) & (np.diff(at) > 0)).tolist():
                    if (key := int(k1[d])) not in seen:
                        seen.add(key)
                        rows.append(d)
                if rows:
                    yield pa.record_batch([pa.array(k1[rows]), pa.array(k2[rows]), pa.array(np.diff(at)[rows]), pa.array([sets[at[d] : at[d + 1]].tobytes() for d in rows], pa.binary())], names=["k1", "k2", "n", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j, pair by pair.

    Few pairs are searched one by one; for many the incidence matrix of the shingles that two
    sets hold is multiplied with its transpose, a slice of columns at a time.
    """
    if len(i) < 8 * len(sets):
        out = np.zeros(len(i), np.int64)
        for at, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            to = np.searchsorted(y, x)
            out[at] = int((y[np.minimum(to, len(y) - 1)] == x).sum())
        return out
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    col = np.concatenate(sets)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    edge = np.concatenate([[True], col[1:] != col[:-1]])
    shared = np.bincount(np.cumsum(edge) - 1)
    keep = np.repeat(shared > 1, shared)
    row, number = row[keep], np.repeat(np.arange(int((shared > 1).sum())), shared[shared > 1])
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, z = np.searchsorted(number, [lo, lo + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[a:z], number[a:z] - lo] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _products(percent: int, spanning: bool, counting: bool):
    """Of the classes of each (component, lo, hi): rows (a, b, n) with links (a, b), n null, and
    with `counting` the number n of links of each class a, b null."""

    def links(rows):
        if len(rows) < 2:
            return
        k1 = [r[0] for r in rows]
        n = np.array([r[1] for r in rows], np.int64)
        block = np.array([r[2] for r in rows])
        cols = [np.frombuffer(r[3], np.int64) for r in rows]
        where = [np.frombuffer(r[4], np.int32) for r in rows]
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        col, pos = np.concatenate(cols), np.concatenate(where)
        order = np.argsort(col, kind="stable")
        col, doc, pos = col[order], doc[order], pos[order]
        edge = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        count = np.zeros((len(rows), len(rows)), np.int32)
        last = np.zeros((len(rows), len(rows)), np.int32)
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(col)], strict=True):
            if hi - lo > 1:  # columns come in their common order, so later positions win
                d = doc[lo:hi]
                at = np.ix_(d, d)
                count[at] += 1
                last[at] = pos[lo:hi][:, None]
        found: list[np.ndarray] = []
        split = block.min() != block.max()
        for lo in range(0, len(rows), 256):
            x, y = np.arange(lo, min(lo + 256, len(rows)))[:, None], np.arange(len(rows))[None, :]
            least = np.minimum(n[x], n[y])
            most = count[x, y] + np.minimum(n[x] - last[x, y], n[y] - last[y, x]) - 1
            ok = (y > x) & (count[x, y] >= _meet(least, percent)) & (100 * least >= percent * np.maximum(n[x], n[y])) & (most >= _need(n[x], n[y], percent))
            if split:
                ok &= block[x] != block[y]
            i, j = np.nonzero(ok)
            found.append(np.stack([lo + i, j, count[lo + i, j]]))
        del last
        i, j, c = np.concatenate(found, axis=1)
        del found, count
        order = np.argsort(-c, kind="stable")
        i, j = i[order], j[order]
        if counting or not spanning:
            good = _overlaps(sets, i, j) >= _need(n[i], n[j], percent)
            i, j = i[good], j[good]
        if counting:
            per = np.bincount(np.concatenate([i, j]), minlength=len(rows))
            for a in np.flatnonzero(per).tolist():
                yield k1[a], None, int(per[a])
        up = list(range(len(rows)))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        left = len(rows) - 1
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if spanning:
                if not left:
                    break  # all are connected
                ra, rb = root(a), root(b)
                if ra == rb:
                    continue
                if not counting and int(_overlaps(sets, np.array([a]), np.array([b]))[0]) < _need(n[a], n[b], percent):
                    continue
                up[max(ra, rb)] = min(ra, rb)
                left -= 1
            yield min(k1[a], k1[b]), max(k1[a], k1[b]), None

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            names = ("component", "lo", "hi", "k1", "n", "block", "cols", "places", "shingles")
            for comp, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (comp, lo, hi) != group:
                    if out := list(links(rows)):
                        yield batch_of(out)
                    group, rows = (comp, lo, hi), []
                rows.append(row)
        if out := list(links(rows)):
            yield batch_of(out)

    return run


def _celled(placed: DataFrame, percent: int) -> DataFrame:
    """Each class of a group of two or more in every cell (lo, hi) of its group that it takes part in.

    A group that fits one block is one cell. Others are cut into bands of set sizes, a band
    just wider than the range in which sets can be alike, and bands into blocks; a cell is a
    pair of blocks of one band or of neighbouring ones.
    """
    band = F.floor(F.log("n") / F.lit(1.000001 * np.log(100 / percent))) if percent < 100 else F.col("n").cast("long")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    large = (F.col("size") > BLOCK) | (F.col("weight") > WEIGHT)
    banded = placed.join(sizes, "component").withColumn("band", F.when(large, band).otherwise(0).cast("long")).drop("size", "weight")
    bands = banded.groupBy("component", "band").agg(F.expr(f"greatest(ceil(count(*) / {BLOCK}), ceil(sum(n) / {WEIGHT}))").cast("long").alias("parts"))
    near = Window.partitionBy("component").orderBy("band")  # a group has as many bands as the logarithm of its largest set

    def neighbour(step: int):
        return F.when(F.lag("band", step).over(near) == F.col("band") - step, F.lag("parts", step).over(near)).otherwise(0)

    bands = bands.withColumn("below", neighbour(1)).withColumn("above", neighbour(-1))
    dealt = banded.join(bands, ["component", "band"]).withColumn("at", F.expr("pmod(xxhash64(k1), parts)"))
    label = "((band + {}) * 1048576L + {})"
    own, under, over = (label.format(d, x) for d, x in ((0, "at"), (-1, "o"), (1, "o")))
    within = f"transform(sequence(0L, parts - 1), o -> named_struct('lo', {label.format(0, 'least(at, o)')}, 'hi', {label.format(0, 'greatest(at, o)')}))"
    up = f"if(above > 0, transform(sequence(0L, above - 1), o -> named_struct('lo', {own}, 'hi', {over})), array())"
    down = f"if(below > 0, transform(sequence(0L, below - 1), o -> named_struct('lo', {under}, 'hi', {own})), array())"
    return dealt.select("component", "k1", "n", F.expr(own).alias("block"), "cols", "places", "shingles", F.expr(f"inline(concat({within}, {up}, {down}))"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, n, cols, places) with the two lists as bytes, columns ascending."""
    for batch in batches:
        cols, places = [], []
        for row in batch.column("cells").to_pylist():
            cols.append(np.array([c["col"] for c in row], np.int64).tobytes())
            places.append(np.array([c["pos"] for c in row], np.int32).tobytes())
        yield pa.record_batch([batch.column("k1"), batch.column("n"), pa.array(cols, pa.binary()), pa.array(places, pa.binary())], names=["k1", "n", "cols", "places"])


def _bitmap(spark, keys: DataFrame):
    """Broadcast bitmap of BITS bits with the bit of every key set; built in Spark."""
    b = F.expr(f"pmod(k1, {BITS}) + 1")
    rows = keys.select(b.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("w")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m")).collect()
    mask = np.zeros(BITS // 8 + 8192, np.uint8)
    for w, m in rows:
        lo = (w - 1) * len(m)
        mask[lo : lo + len(m)] |= np.frombuffer(bytes(m), np.uint8)
    return spark.sparkContext.broadcast(mask)


def _twins(members: DataFrame) -> dict[tuple[int, int], int]:
    """Another name for each class whose 64 bits are those of a class with less in the other 64.

    Among n classes n^2 / 2^65 are to be expected: none below some billions.
    """
    keys = members.where("n > 0").select("k1", "k2").distinct()
    several = keys.groupBy("k1").agg(F.min("k2").alias("first"), F.count("*").alias("m")).where("m > 1")
    rows = keys.join(several, "k1").where("k2 > first").select("k1", "k2", F.xxhash64("k1", "k2", F.lit("twin")).alias("name")).collect()
    return {(r["k1"], r["k2"]): r["name"] for r in rows}


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, lower: bool = True, spanning: bool = True, counting: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, counts): rows (doc_id, n, k1, k2) of all documents, links (a, b), and (k1, n_links).

    A link joins two different shingle sets (`k1`) with 100 * I >= percent * U. With
    `spanning`, links between sets already known to be connected are left out; without
    it every link is returned. With `counting` each set's number of links is in counts, which
    else is empty. Null text or text without words: n = 0, never linked. Repeated rows and
    null ids stay rows of their own.
    """
    with Scratch() as own:
        members, links = _classes(docs, id_col, text_col, k, percent, lower, spanning, counting)
        own.keep(members, links)
    per = links.where("b is null").groupBy(F.col("a").alias("k1")).agg(F.sum("n").alias("n_links"))
    return members.where("bucket is null").drop("bucket"), links.where("b is not null").select("a", "b"), per


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, lower: bool, spanning: bool, counting: bool) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    base = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    described = stash(base.mapInArrow(_describe(k, lower), f"doc_id {id_type}, n long, k1 long, k2 long, bucket long"))
    table = np.zeros(BUCKETS, np.int64)
    sums = described.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("c")).toArrow()  # at most BUCKETS rows
    table[sums.column("bucket").to_numpy()] = sums.column("c").to_numpy()
    counts = spark.sparkContext.broadcast(_level_of(table).astype(np.uint16))
    twins = _twins(described.where("bucket is null"))
    if twins:
        renamed = spark.createDataFrame([(*key, name) for key, name in twins.items()], "k1 long, k2 long, name long")
        described = stash(described.join(F.broadcast(renamed), ["k1", "k2"], "left").select("doc_id", "n", F.coalesce("name", "k1").alias("k1"), "k2", "bucket"))

    parts = ranges_for(spark)
    prefix = base.select("text").mapInArrow(_prefixes(k, lower, percent, counts, twins), "col long, salt int, k1 long, n int, pos int")
    rows = stash(prefix.repartition(parts, "col", "salt").sortWithinPartitions("col", "salt", "k1").mapInArrow(_shared, "col long, k1 long, n int, pos int"))
    need = F.expr(f"least(greatest({SHARED}, n div 20), ({percent} * n + 99) div 100)")
    for _ in range(2):  # classes need columns, columns need two classes
        rich = rows.groupBy("k1", "n").agg(F.count("*").alias("m")).where(F.col("m") >= need).select("k1")
        rows = rows.join(rich, "k1")
        met = rows.groupBy("col").agg(F.count("*").alias("m")).where("m > 1").select("col")
        rows = stash(rows.join(met, "col"))
    width = rows.groupBy("col").agg(F.count("*").alias("width"))
    wide = rows.join(width, "col")
    long = wide.where(F.col("width") > SMALL).groupBy("k1").agg(F.count("*").alias("long"))
    wide = stash(wide.join(long, "k1", "left").withColumn("long", F.coalesce("long", F.lit(0))))
    short = wide.where(F.col("width") <= SMALL).select("col", "n", "k1", "pos", "long")
    near = short.repartition(parts, "col").sortWithinPartitions("col", "n", "k1").mapInArrow(_small_pairs(percent), "a long, b long, need long, spare long")
    near = near.groupBy("a", "b", "need", "spare").agg(F.count("*").alias("c")).where("c + spare >= need")
    edges = near.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = edges.unionByName(wide.where((F.col("width") > SMALL) & (F.col("long") >= need)).select(F.col("k1").alias("u"), F.col("col").alias("v")))
    groups = stash(components(edges))
    chosen = rows.join(groups.select(F.col("node").alias("k1")), "k1", "left_semi")
    classes = stash(chosen.groupBy("k1", "n").agg(F.sort_array(F.collect_list(F.struct("col", "pos"))).alias("cells")).mapInArrow(_packed, "k1 long, n int, cols binary, places binary"))
    bits = _bitmap(spark, classes.select("k1"))
    active = base.select("text").mapInArrow(_active_sets(k, lower, bits, twins), "k1 long, k2 long, n long, shingles binary").select("k1", "shingles").dropDuplicates(["k1"])
    placed = classes.join(groups.withColumnRenamed("node", "k1"), "k1").join(active, "k1")
    cells = _celled(placed, percent).repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return described, stash(cells.mapInArrow(_products(percent, spanning, counting), "a long, b long, n long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, lower: bool = True, counting: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id[, n_links].

    component_id is the least id reachable over links, the document's own included;
    class_id the least id with the same shingle set; with `counting`, n_links is the number of
    other sets that the document's set is linked with. Documents without words are alone,
    and so is each row of theirs; a null id takes part, but is never the least.
    """
    with Scratch() as own:
        members, links, counts = jaccard_classes(docs, id_col, text_col, k, percent, lower, counting=counting)
        comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "k1")
        classes = members.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"))
        placed = classes.join(comp, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
        placed = placed.join(counts, "k1", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
        least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
        full = stash(placed.join(least, "component").select("k1", "k2", "class_id", "component_id", "n_links"))
        ids = stash(members)
        own.keep(full, ids)
    has = ids.where("n > 0").join(full, ["k1", "k2"])
    alone = {"class_id": F.col("doc_id"), "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}
    out = has.unionByName(ids.where("n = 0").withColumns(alone))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", *(["n_links"] if counting else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the least id; all columns kept, whatever their names.

    Documents without words and rows without an id are kept. Where an id is repeated, of
    its rows with equal texts one is kept.
    """
    (chosen_id,) = fresh(docs, "chosen_id")
    with Scratch() as own:
        rows = stash(jaccard_components(docs, id_col, text_col, k, percent))
        own.keep(rows)
    chosen = rows.where("n_shingles = 0 or doc_id = component_id").select(F.col("doc_id").alias(chosen_id)).distinct()
    kept = docs.join(chosen, named(id_col) == F.col(chosen_id), "left_semi")
    twice = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.where(named(id_col).isNull()))
