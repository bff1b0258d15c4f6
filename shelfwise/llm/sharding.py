"""Sharding by a Feistel permutation of global row numbers.

Rows get their number in the order of (id, text digest); a keyed Feistel network over
Z_a x Z_b, the least such grid of a nearly square shape that holds all numbers, permutes
them, and walks on along its cycle while it leaves the range. Shard and slot are the
remainder and the quotient of the permuted number: any row's place can be computed from
its number alone, counts differ by one at most, and slots have no gaps. DataFrame
functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh, named, with_row_numbers

ROUNDS = 6
WALK = 64


def permuted(number: str, n: int, seed: int) -> F.Column:
    """The permuted value of column `number` (0 <= number < n), as SQL expressions.

    Fewer than `a` points of the grid lie outside the range, so a walk ends after at most
    that many steps; beyond WALK steps (never met unless a > WALK, and then with odds
    under (1/a)**WALK) the query fails rather than return a wrong place.
    """
    n = max(n, 1)
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def once(x: str, s: str, i: str) -> str:
        left = f"named_struct('l', pmod({s}.l + pmod(xxhash64({s}.r, {i}, {seed}L), {a}L), {a}L), 'r', {s}.r)"
        right = f"named_struct('l', {s}.l, 'r', pmod({s}.r + pmod(xxhash64({s}.l, {i}, {seed}L), {b}L), {b}L))"
        start = f"named_struct('l', {x} div {b}L, 'r', {x} % {b}L)"
        return f"aggregate(sequence(1, {ROUNDS}), {start}, ({s}, {i}) -> if({i} % 2 = 1, {left}, {right}), {s} -> {s}.l * {b}L + {s}.r)"

    walked = f"aggregate(sequence(1, {WALK}), {once(number, 's', 'i')}, (p, w) -> if(p < {n}L, p, {once('p', 't', 'j')}))"
    return F.expr(f"transform(array({walked}), p -> if(p < {n}L, p, raise_error('cycle walk too long')))[0]")


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, row_number, shard, slot, grown_shard) for all rows.

    Law `rows`: shard counts are at most one apart. Size is the UTF-8 length plus 1; a
    null text has length 0 and the digest of the empty text. Null ids come first, repeated
    rows get numbers of their own, an empty table gives an empty result; other columns of
    the input are not read. grown_shard is null: this law moves rows when a shard is added.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    (number,) = fresh(docs.select(named(id_col)), "row_number")
    base = docs.select(
        named(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = with_row_numbers(base, number, [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    place = numbered.withColumn("p", permuted(number, n, seed))
    return place.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % n_shards).cast("int").alias("shard"),
        F.expr(f"p div {n_shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col(number),
    )
