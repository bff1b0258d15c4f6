"""One-permutation MinHash fingerprints in DataFrame functions only.

Word shingles are hashed once; the top bits of a hash choose one of `BINS` bins and each
bin keeps its least hash. An empty bin b takes the value of the filled bin j with the least
shared random hash of (b, j), which is the outcome of probing bins in a random order common
to all texts until a filled one is met (optimal densification). The low `BITS` bits of each
bin are packed as hex; likeness corrects the share of equal bins for chance agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, named, ranges_for, with_row_numbers

BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS = 1 << BIN_BITS
BUCKET_ROWS, BUCKETS_A_TASK = 512, 4
_SPACES = r"[\x20\x09-\x0D]+"


def _bin(x: str) -> str:
    return f"shiftrightunsigned({x}, {64 - BIN_BITS})"


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = SHINGLE) -> DataFrame:
    """Add `name` (hex string) and `name`_bins (low bits of each bin) for string column `text`.

    A text of 1 to k-1 words has its whole sequence as its one shingle; without words the
    fingerprint is the empty string and the bins are empty. Null counts as empty.
    """
    w, s, m, f = (f"__{name}_{x}" for x in "wsmf")
    words = f"transform(filter(split(coalesce({text}, ''), r'{_SPACES}'), x -> x <> ''), x -> xxhash64(x))"
    # every array that a lambda looks into is used twice outside of it or in it: the planner
    # then keeps it as a column of its own, and does not evaluate it anew for each element
    df = df.withColumn(w, F.expr(words))
    many = "xxhash64(" + ", ".join(f"{w}[i + {j}]" for j in range(k)) + ")"
    hashes = f"case when size({w}) >= {k} then transform(sequence(0, size({w}) - {k}), i -> {many}) when size({w}) > 0 then array(xxhash64({w})) else cast(array() as array<bigint>) end"
    df = df.withColumn(s, F.sort_array(F.expr(hashes)))
    df = df.withColumn(m, F.expr(f"filter({s}, (x, i) -> i = 0 or {_bin('x')} <> {_bin(f'{s}[i - 1]')})"))
    df = df.withColumn(f, F.expr(f"map_from_arrays(transform({m}, x -> {_bin('x')}), {m})"))
    nearest = f"array_min(transform({m}, x -> named_struct('at', xxhash64(b, {_bin('x')}), 'value', x))).value"
    filled = f"transform(sequence(0L, {BINS - 1}L), b -> cast(coalesce({f}[b], {nearest}) & {(1 << BITS) - 1} as smallint))"
    df = df.withColumn(f"{name}_bins", F.expr(f"if(size({f}) = 0, cast(array() as array<smallint>), {filled})"))
    df = df.drop(w, s, m, f)
    return df.withColumn(name, F.expr(f"lower(array_join(transform({name}_bins, v -> lpad(hex(v), {BITS // 4}, '0')), ''))"))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two columns of bins, corrected for chance."""
    chance = 2.0**-BITS
    equal = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), x -> x))"
    both = f"greatest(0D, least(1D, ({equal} / {BINS}D - {chance}D) / {1 - chance}D))"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {both} end")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Rows (id, fingerprint, fingerprint_bins) of all documents."""
    return with_fingerprint(docs.select(named(id_col), named(text_col).cast("string").alias("text")), "text", "fingerprint", k).drop("text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text, its edited text and the next document's, and likenesses.

    Next is by descending id (null ids last, rows of one id by descending hash of the text),
    and the first after the last. Documents are cut into buckets at exact ranks of (id, hash),
    some for each shuffle partition; the first row of a bucket is copied to the end of the
    bucket before it, so that each bucket is a window of its own and no global order is needed.
    Texts are shuffled once. Only rows equal in id and text can not be cut apart.
    """
    key = F.struct(named(id_col).alias("id"), F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit(""))).alias("h"))
    keys = docs.select(key.alias("key"))
    with Scratch():
        ranked, n = with_row_numbers(keys, "rank_at", [F.col("key").asc()])
        rows = max(BUCKET_ROWS, -(-n // (BUCKETS_A_TASK * ranges_for(docs.sparkSession))))
        # as many values as buckets
        cuts = sorted({(r["id"], r["h"]) for r in ranked.where((F.col("rank_at") % rows == 0) & (F.col("rank_at") > 0)).select("key.*").collect() if r["id"] is not None})
        least = ranked.agg(F.min("key")).head()[0]
        cuts = [c for c in cuts if c != (least["id"], least["h"])]
        kind = keys.schema["key"].dataType.simpleString()

        def listed(values) -> Column:
            return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(h).cast("long").alias("h")) for i, h in values]).cast(f"array<{kind}>")

        def bucket_of(k: Column) -> Column:
            return F.size(F.filter(listed(cuts), lambda c: c <= k)) if cuts else F.lit(0)

        tops = dict(ranked.groupBy(bucket_of(F.col("key")).alias("b")).agg(F.max("key")).collect())
    firsts = [(tops[b]["id"], tops[b]["h"]) for b in range(len(cuts) + 1)] if tops else [(None, 0)]
    base = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), key.alias("key"))
    base = base.withColumn("bucket", bucket_of(F.col("key")))
    is_first = F.col("key").eqNullSafe(F.element_at(listed(firsts), F.col("bucket") + 1))
    to = F.when(is_first, F.array(F.col("bucket"), (F.col("bucket") + 1) % (len(cuts) + 1))).otherwise(F.array("bucket"))
    placed = base.select("key", "text", F.posexplode(to).alias("copy", "bucket"))
    w = Window.partitionBy("bucket").orderBy("copy", F.col("key").desc())
    n_chars = F.length("text")
    out = placed.select("key", "bucket", "copy", "text", F.lead("text").over(w).alias("next_text"))
    out = out.withColumn("n_chars", n_chars.cast("long"))
    out = out.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 2 as int))"))).drop("next_text")
    out = with_fingerprint(out, "text", "fingerprint", k)
    out = out.withColumn("next_bins", F.lead("fingerprint_bins").over(w))
    out = with_fingerprint(out.where("copy = 0"), "edited", "edited_fingerprint", k)
    return out.select(
        F.col("key.id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint_bins", "edited_fingerprint_bins").alias("near_edited"),
        likeness("fingerprint_bins", "next_bins").alias("near_next"),
    )
