"""Vocabulary, TF-IDF and BM25 vectors, latent semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_frequency(terms: DataFrame) -> DataFrame:
    """Rows (term, df, total) of (doc_id, term[, weight]) with one row for each pair: documents and weights.

    The weight is counted, so that this reads the same columns as a join with the terms: the
    planner then computes and exchanges them once. Without weights each pair weighs 1.
    """
    weight = F.col("weight") if "weight" in terms.columns else F.lit(1.0)
    return terms.groupBy("term").agg(F.count(weight).alias("df"), F.sum(weight.cast("decimal(20,6)")).alias("total"))


def vocabulary(terms: DataFrame, n_docs: int, min_df: int = 2, max_df_ratio: float = 0.4, cap: int = 0, bm25: bool = False) -> DataFrame:
    """Rows (term, df, total, idf): terms in at least min_df and at most ceil(ratio * n) documents.

    A ceiling below min_df is lifted to n. With a cap, terms of the largest df * idf stay.
    Terms are (doc_id, term[, weight]), or counted already: (term, df, total).
    """
    counted = terms if "df" in terms.columns else document_frequency(terms)
    out = counted.where(F.col("df").between(min_df, ceiling_of(n_docs, min_df, max_df_ratio))).withColumn("idf", idf(F.col("df"), n_docs, bm25))
    return out.orderBy(F.desc(F.round(F.col("df") * F.col("idf"), 9)), "term").limit(cap) if cap > 0 else out


def ceiling_of(n_docs: int, min_df: int, max_df_ratio: float) -> int:
    ceiling = int(np.ceil(max_df_ratio * n_docs - 1e-9))
    return n_docs if ceiling < min_df else ceiling


def idf(df: Column, n_docs: int, bm25: bool = False) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5)) if bm25 else F.log(F.lit(n_docs + 1.0) / (df + 1.0)) + 1.0


def tfidf(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (doc_id, term, val), unit length by document. Weights under 1 count in proportion."""
    tf = F.col("weight")
    w = F.when(tf < 1, tf * F.col("idf")).otherwise((1 + F.log(tf)) * F.col("idf"))
    return unit(terms.join(vocab, "term").select("doc_id", "term", w.alias("w")))


def bm25(terms: DataFrame, vocab: DataFrame, n_docs: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows (doc_id, term, val), unit length. Lengths are sums of in-vocabulary weights."""
    k1 = k1 if k1 > 0 else 1.2
    b = b if 0 <= b <= 1 else 0.75
    mean = vocab.agg(F.sum("total").cast("double")).head()[0] or 0.0
    mean = mean / max(n_docs, 1) or 1.0
    inside = terms.join(vocab.select("term", "idf"), "term")
    length = F.sum(F.col("weight").cast("decimal(20,6)")).over(Window.partitionBy("doc_id")).cast("double")
    tf = F.col("weight")
    w = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
    return unit(inside.withColumn("len", length).select("doc_id", "term", w.alias("w")))


def unit(weights: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weights.select("doc_id", "term", F.when(norm > 0, F.col("w") / norm).otherwise(F.col("w")).alias("val"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two array<double> columns: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def matrix_or_nan(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """As `matrix`; rows that are null are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count:
        return matrix(column)
    some = matrix(column.drop_null())
    out = np.full((len(column), some.shape[1]), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = some
    return out


def dimensions(vocab: DataFrame) -> DataFrame:
    """Rows (term, dim): positions by term. The vocabulary is small beside the corpus."""
    return vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("dim"))


def latent_space(vectors: DataFrame, vocab: DataFrame, dims: int = 150, seed: int = 1, power: int = 4, oversample: int | None = None) -> DataFrame:
    """Rows (doc_id, vec): coordinates U * Sigma of a randomised truncated SVD, unit length.

    Documents stay distributed: every pass multiplies blocks of rows with a small dense
    matrix (vocabulary x sketch), and only such matrices reach the driver. The sketch is
    dims plus half as many columns (ten at least). Fewer documents or terms than dims clamp
    it to their least number, less one.
    """
    index = dimensions(vocab)
    cells = F.sort_array(F.collect_list(F.struct("dim", "val")))
    rows = vectors.join(index, "term").groupBy("doc_id").agg(cells.alias("cells")).select("doc_id", F.col("cells.dim").alias("dims"), F.col("cells.val").alias("vals"))
    return latent_space_of(rows, index.count(), dims, seed, power, oversample)


def latent_space_of(rows: DataFrame, d: int, dims: int = 150, seed: int = 1, power: int = 4, oversample: int | None = None) -> DataFrame:
    """`latent_space` of rows (doc_id, dims, vals): places below d in order, and their values.

    A pass adds up in as many tasks as the session has cores, whatever the rows: each sends a
    matrix, and so what is exchanged does not grow with them.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    n = rows.count()
    least = min(n, d)
    if least == 0:
        return spark.createDataFrame([], "doc_id long, vec array<double>")
    k = (dims if dims > 0 else 200) if dims < least else max(1, least - 1)
    wide = min(least, k + (oversample if oversample is not None else max(10, k // 2)))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]

    def gram_times(m: np.ndarray) -> np.ndarray:
        """(A^T A) m: each task adds up its documents, CHUNK terms of the sums are a row."""
        shared = spark.sparkContext.broadcast(m)

        def run(batches):
            out, some = np.zeros_like(shared.value), False
            for batch in batches:
                for at, v, own in _blocks(batch):
                    y = np.add.reduceat(v[:, None] * shared.value[at], own)  # A m, by document
                    doc = np.repeat(np.arange(len(own)), np.diff(np.append(own, len(at))))
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                    out[at[order][first]] += np.add.reduceat(v[order, None] * y[doc[order]], first)
                    some = True
            for lo in range(0, len(out) if some else 0, CHUNK):
                yield pa.record_batch([pa.array([lo], pa.int32()), pa.array([out[lo : lo + CHUNK].tobytes()], pa.binary())], names=["at", "sums"])

        def added(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_buffer()) for b in table.column("sums"))
            return pa.table({"at": table.column("at")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        shape = "at int, sums binary"
        few = rows.select("dims", "vals").coalesce(spark.sparkContext.defaultParallelism)
        parts = few.mapInArrow(run, shape).groupBy("at").applyInArrow(added, shape).toArrow()  # a matrix like m
        out = np.zeros_like(m)
        for lo, b in zip(parts.column("at").to_pylist(), parts.column("sums"), strict=True):
            part = np.frombuffer(b.as_buffer()).reshape(-1, m.shape[1])
            out[lo : lo + len(part)] = part
        return out

    for _ in range(power + 1):
        basis = np.linalg.qr(gram_times(basis))[0]
    small = basis.T @ gram_times(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    order = order[values[order] > (1e-7**2) * max(values.max(), 0)]
    shared = spark.sparkContext.broadcast(basis @ turn[:, order])
    kind = rows.schema["doc_id"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for at, v, own in _blocks(batch):
                y = np.add.reduceat(v[:, None] * shared.value[at], own)
                norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
                y /= np.where(norm > 0, norm, 1)
                vec = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([ids.slice(done, len(y)), vec], names=["doc_id", "vec"])
                done += len(y)

    return rows.mapInArrow(project, f"doc_id {kind}, vec array<double>")


CHUNK, CELLS = 512, 1 << 14


def _blocks(batch: pa.RecordBatch):
    """(dims, values, start of each document) of about CELLS cells of whole documents; none is empty."""
    dims, vals = batch.column("dims"), batch.column("vals")
    size = dims.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, v = dims.flatten().to_numpy(zero_copy_only=False), vals.flatten().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(size):
        lo = ends[i] - size[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CELLS, "right")))
        yield at[lo : ends[j - 1]], v[lo : ends[j - 1]], ends[i:j] - size[i:j] - lo
        i = j
