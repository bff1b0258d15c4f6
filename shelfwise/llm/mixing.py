"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is a share of the wanted total, stopped at `cap` times the source's
size. All documents of a source have the same expected number of copies; its fractional
part is rounded by pivotal steps: two documents with fractions left exchange words until
one of them is whole, so a source's words never move. Rows are dealt to (source, chunk)
groups by a hash; each group leaves at most one fractional document, and these meet in a
reduction tree of fan-in `FAN_IN` until one is left per source, which goes to the nearer
side, so that a source misses its target by half a document at most.
Rows equal in id, source, size and text are one document of the rounding, however many they
are, and share its copies as evenly as can be. Random numbers are hashes of the row, so
reruns agree whatever the partitioning.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, fresh, named, ranges_for, stash, with_row_numbers

CHUNK_ROWS = 1 << 13
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (source, source_size, weight, target): weights repeat over sources by code point.

    A source's target is its weight's share; where that exceeds cap * size it stops there
    and the excess is shared anew by weight among the rest, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked, _ = with_row_numbers(per, "at", [F.col("source").asc_nulls_last()])
    table = stash(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))))
    all_size, w = table.agg(F.sum("source_size"), F.sum("weight")).head()
    budget = total * (all_size or 0)
    level, stopped = (budget / w if w else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        n, taken, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).head()
        if n == stopped or not free:
            break
        stopped, level = n, (budget - cap * (taken or 0)) / free
    limit = cap * F.col("source_size")
    return table.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(float(level)), limit).cast("double").alias("target"))


def _pivot(last: bool):
    """Pivotal rounding of rows sorted by (source, chunk, id): at most one fraction a group."""

    def run(batches):
        held = None  # the document with a fraction left: [row, fraction]
        group = object()
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            rows = list(zip(*cols.values(), strict=True))
            names = list(cols)
            at = {c: i for i, c in enumerate(names)}
            out = []
            for row in rows:
                key = (row[at["source"]], row[at["chunk"]])
                if key != group:
                    if held:
                        out.append(_closed(held, at, last))
                    held, group = None, key
                p, size = row[at["fraction"]], row[at["size"]]
                if not size or p <= 0.0 or p >= 1.0:
                    out.append(_set(row, at, 0.0 if not size or p <= 0.0 else 1.0))
                    continue
                if held is None:
                    held = [row, p]
                    continue
                other, q = held
                other_size = other[at["size"]]
                # words that can move to the held document, and from it
                to_held = min((1 - q) * other_size, p * size)
                from_held = min(q * other_size, (1 - p) * size)
                if row[at["draw"]] * (to_held + from_held) < from_held:
                    full = to_held == (1 - q) * other_size
                    q2, p2 = (1.0, p - to_held / size) if full else (q + to_held / other_size, 0.0)
                else:
                    empty = from_held == q * other_size
                    q2, p2 = (0.0, p + from_held / size) if empty else (q - from_held / other_size, 1.0)
                left = []
                for r, x in ((other, q2), (row, p2)):
                    if 1e-12 < x < 1 - 1e-12:
                        left.append([r, x])
                    else:
                        out.append(_set(r, at, float(round(x))))
                held = left[0] if left else None
            if out:
                yield _batch(out, names, batch.schema)
        if held:
            yield _batch([_closed(held, at, last)], names, batch.schema)

    return run


def _set(row, at, p):
    row = list(row)
    row[at["fraction"]] = p
    return row


def _closed(held, at, last):
    row, p = held
    return _set(row, at, float(p >= 0.5) if last else p)


def _batch(rows, names, schema):
    return pa.record_batch([pa.array(list(c), schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=schema)


_PARTS = ("doc_id", "source", "size", "digest")


def _key(parts) -> list:
    """128 bits by which equal documents are known; nulls are equal."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(97), *parts)]


def _allotted(rows: DataFrame, keys: list[str], totals: DataFrame, rows_col: str, total_col: str, name: str) -> DataFrame:
    """`rows` with `name`: the share of each in its key's total, which differ by one at most.

    Rows of one key are alike. Those of keys met once take the total; the others are written,
    numbered by part and by the parts' counts, so no task sees all rows of a key.
    """
    joined = rows.join(totals, keys)
    once = joined.where(F.col(rows_col) == 1).withColumn(name, F.col(total_col))
    if not totals.where(F.col(rows_col) > 1).limit(1).count():
        return once
    mark, part, at, size, before = fresh(once, "mark", "part", "at", "size", "before")
    some = stash(joined.where(F.col(rows_col) > 1).withColumn(mark, F.monotonically_increasing_id())).withColumn(part, F.shiftright(mark, 33))
    per = some.groupBy(*keys, part).agg(F.count("*").alias(size))
    lows = per.withColumn(before, F.sum(size).over(Window.partitionBy(*keys).orderBy(part)) - F.col(size)).drop(size)
    numbered = some.withColumn(at, F.row_number().over(Window.partitionBy(*keys, part).orderBy(mark))).join(lows, [*keys, part])
    number, m, total = F.col(before) + F.col(at) - 1, named(rows_col), named(total_col)
    share = F.floor(total / m) + F.when(number < total % m, 1).otherwise(0)
    return once.unionByName(numbered.withColumn(name, share).select(*map(named, once.columns)))


def totals(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """Rows (doc_id, source, size[, digest], n, source_size, target, total): equal rows in one, stashed."""
    spark = sizes.sparkSession
    parts = [c for c in _PARTS if c in sizes.columns]
    with Scratch() as own:
        goal = stash(targets(sizes, weights, total, cap))
        same = sizes.groupBy(*parts).agg(F.count("*").alias("n"))
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
        rows = same.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "source_size", "target", ratio.alias("ratio"))
        base = F.floor(F.col("ratio") + 1e-12)
        chunks = max(1, -(-sizes.count() // CHUNK_ROWS))

        def draw(*more):
            return F.pmod(F.xxhash64(*parts, *more), F.lit(1 << 52)) / float(1 << 52)

        now = rows.select(
            *parts, "n", "source_size", "target",
            base.cast("long").alias("base"),
            F.greatest(F.col("ratio") - base, F.lit(0.0)).cast("double").alias("fraction"),
            F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(chunks)).cast("long").alias("chunk"),
            draw(F.lit(seed + 1)).alias("draw"),
        )
        shape, done = now.schema, []
        while True:
            last = chunks == 1
            dealt = now.repartition(ranges_for(spark), "source", "chunk").sortWithinPartitions("source", "chunk", *parts)
            out = stash(dealt.mapInArrow(_pivot(last), shape))
            done.append(out.where("fraction in (0, 1)"))
            if last:
                break
            chunks = -(-chunks // FAN_IN)
            now = out.where("fraction not in (0, 1)").withColumn("chunk", F.expr(f"chunk div {FAN_IN}"))
            # a fresh draw for each level of the tree
            now = now.withColumn("draw", draw("chunk", F.lit(seed + 2 + len(done))))
        whole = done[0]
        for more in done[1:]:
            whole = whole.unionByName(more)
        found = stash(whole.select(*parts, "n", "source_size", "target", (F.col("base") + F.col("fraction")).cast("long").alias("total")))
        own.keep(found)
    return found


def mix(sizes: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies) for those of (doc_id, source, size[, digest]).

    A document is taken floor(r) or ceil(r) times, r being its source's target by its size;
    documents of size 0 are taken floor(r) times. Null sources are one source, the last; null
    ids are an id. Equal rows share their copies.
    """
    parts = [c for c in _PARTS if c in sizes.columns]
    found = totals(sizes, **options)
    k1, k2 = _key(parts)
    keyed = found.select(k1.alias("k1"), k2.alias("k2"), "n", "total", "source_size", "target")
    out = _allotted(sizes.withColumn("k1", k1).withColumn("k2", k2), ["k1", "k2"], keyed, "n", "total", "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def _described(id_col: str, text_col: str, source_col: str) -> list:
    """Id, source, size and digest of a document as columns."""
    text = named(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return [named(id_col), named(source_col), words, F.xxhash64(text)]


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, digest): words of the whole text, 0 for null; stashed."""
    return stash(docs.select(*(c.alias(n) for c, n in zip(_described(id_col, text_col, source_col), _PARTS, strict=True))))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns, whatever their names.

    Of rows equal in id, source and text but not in other columns any may be taken more often.
    """
    with Scratch() as own:
        found = totals(document_sizes(docs, id_col, text_col, source_col), **options)
        own.keep(found)
    n, total, copies, a, b, each = fresh(docs, "n", "total", "copies", "key_a", "key_b", "copy")
    k1, k2 = _key(_PARTS)
    keyed = found.select(k1.alias(a), k2.alias(b), F.col("n").alias(n), F.col("total").alias(total))
    k1, k2 = _key(_described(id_col, text_col, source_col))
    out = _allotted(docs.withColumn(a, k1).withColumn(b, k2), [a, b], keyed.where(F.col(total) > 0), n, total, copies)
    return out.where(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*map(named, docs.columns))
