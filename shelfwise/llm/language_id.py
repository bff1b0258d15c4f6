"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts become hashed counts of 1 to 3 byte grams of their letters, damped, weighted by inverse
document frequency and normalised. Each language has several centroids, found by spherical
k-means on a bounded sample; the nearest one by cosine decides, and a text further away from
it than almost all labelled ones of its language is rejected. Document frequencies are counted over all
learnable documents; the sample (about `SAMPLE` distinct texts by their hash, three quarters
of them dealt evenly to languages and a quarter by their rows) only places the centroids and
the limits of rejection. The `SAMPLE` most frequent languages take part, with a warning if there
are more; a rarer one gets no centroid. What is broadcast has a fixed size for each language.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch, named, others, shape_of, stash, text_rows
from .words import slices, utf8

DIMS = 4096
SAMPLE = 2000
CLUSTERS = 4
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
SLICE = 1 << 19
FOLDS = 4
HASHES = 1 << 30
CALIBRATED = 10  # rows that a language needs for a limit of its own


def gram_counts(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Counts (texts x DIMS) of 1- to 3-byte grams, none across two texts or without letters."""
    n = len(own) - 1
    b = _FOLD[part].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(own))
    out = np.zeros(n * DIMS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for k in range(1, 4):
        if len(b) < k:
            break
        code = (code[: len(b) - k + 1] << np.uint32(8)) | b[k - 1 :] if k > 1 else b
        same = doc[: len(code)] == doc[k - 1 :]
        blank = (b[: len(code)] == 32) & (b[k - 1 :] == 32)
        use = same & ~blank
        dim = ((code[use] + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(doc[: len(code)][use] * DIMS + dim, minlength=n * DIMS).astype(np.float32)
    return out.reshape(n, DIMS)


def unit_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def _sliced(column: pa.Array):
    buf, offs = utf8(column)
    for i, j in slices(offs, SLICE):
        for lo in range(i, j, 256):
            hi = min(lo + 256, j)
            yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for lo, hi, part, own in _sliced(batch.column("text")):
            df += (gram_counts(part, own) > 0).sum(axis=0)
            n += hi - lo
    if n:
        yield pa.record_batch([pa.array(np.append(np.arange(DIMS), -1).astype(np.int32)), pa.array(np.append(df, n))], names=["dim", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, part, own in _sliced(batch.column("text")):
            counts = np.minimum(gram_counts(part, own), 65535).astype(np.uint16)
            yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("lang", "fold")), pa.array([c.tobytes() for c in counts], pa.binary())], names=["lang", "fold", "counts"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the first is the mean, further ones start at the row furthest from all."""
    mean = x.mean(axis=0)
    start = [mean / max(float(np.linalg.norm(mean)), 1e-9)]
    while len(start) < min(k, len(x)):
        near = np.max(x @ np.array(start).T, axis=1)
        start.append(x[int(np.argmin(near))])
    c = np.array(start)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = c.copy()
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                new[j] = m / max(float(np.linalg.norm(m)), 1e-9)
        if np.allclose(new, c):
            break
        c = new
    return c


def floor_of(cos: np.ndarray) -> float:
    """The 1 % quantile, less a share of its distance from the median: a third, more below 60 rows."""
    low, mid = np.quantile(cos, [0.01, 0.5])
    return max(0.0, float(low - (mid - low) * max(1 / 3, min(1.0, 20 / len(cos)))))


def _floors(x: np.ndarray, lang: np.ndarray, fold: np.ndarray, langs: list[str], centroids: np.ndarray, clusters: int) -> np.ndarray:
    """The floor of each centroid, by its language, from cosines to centroids learned without the row.

    Each fold meets centroids of its language learned from the other folds. Rows nearer to
    another language do not count. Languages with fewer than CALIBRATED rows left share the
    floor of all rows left.
    """
    own, cos = np.array(langs), {}
    for name in sorted(set(langs)):
        mine, other = lang == name, centroids[own != name]
        found = []
        for f in range(FOLDS):
            rows, rest = x[mine & (fold == f)], x[mine & (fold != f)]
            if len(rows) and len(rest):
                near = (rows @ spherical_kmeans(rest, clusters).T).max(axis=1)
                found.append(near[near >= (rows @ other.T).max(axis=1)] if len(other) else near)
        cos[name] = np.concatenate(found) if found else np.zeros(0)
    left = np.concatenate(list(cos.values()))
    shared = floor_of(left) if len(left) else 0.0
    floor = {name: floor_of(c) if len(c) >= CALIBRATED else shared for name, c in cos.items()}
    return np.array([floor[name] for name in langs])


@dataclass
class Model:
    langs: list[str]  # one for each centroid
    centroids: np.ndarray
    floors: np.ndarray  # cosine below which a text is rejected, by centroid
    idf: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each row."""
        cos = unit_rows(counts, self.idf) @ self.centroids.T
        at = np.argmax(cos, axis=1)
        best = cos[np.arange(len(at)), at]
        return [self.langs[a] for a in at.tolist()], np.clip(best, 0.0, 1.0), best < self.floors[at]


def fit(docs: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model | None:
    """Learn from rows where `learnable` holds and language and text are not null.

    All texts of the sample place the centroids; floors come from cosines of the sample's folds
    (by a hash of the text) to centroids learned without them. A text counts once in the sample
    for each language, however often it is repeated; ids and other columns are not read.
    None without a usable row.
    """
    rows = docs.where(learnable & named(lang_col).isNotNull() & named(text_col).isNotNull())
    base = rows.select(named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text"))
    df = dict(base.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())  # DIMS + 1 rows
    total = df.pop(-1, 0)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + np.array([df.get(d, 0) for d in range(DIMS)]))).astype(np.float32) + np.float32(1)
    per = base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample + 1).collect()
    if len(per) > sample:
        warnings.warn(f"only the {sample} most frequent languages get centroids", stacklevel=2)
        per = per[:sample]
    even, spare = max(1.0, 0.75 * sample / len(per)), 0.25 * sample / total
    # the texts of least hash of each language: a threshold that surely leaves enough, then ranks
    quota = [even + spare * r["n"] for r in per]
    share = docs.sparkSession.createDataFrame([(r["lang"], HASHES * (2 * q + 16) / r["n"], -int(-q // 1)) for r, q in zip(per, quota, strict=True)], "lang string, below double, most int")
    hashed = base.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(HASHES)))
    near = hashed.join(F.broadcast(share), "lang").where("h < below").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = near.withColumn("place", place).where("place <= most").withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int"))
    with Scratch():
        got = stash(chosen.select("lang", "fold", "text").mapInArrow(_vectors, "lang string, fold int, counts binary")).orderBy("lang", "counts").toArrow()
    lang, fold = np.array(got.column("lang").to_pylist()), np.array(got.column("fold").to_pylist(), int)
    if not len(lang):
        raise ValueError("no labelled row was chosen for the sample")
    x = np.empty((len(lang), DIMS), np.float32)
    for i, b in enumerate(got.column("counts")):
        x[i] = unit_rows(np.frombuffer(b.as_buffer(), np.uint16)[None, :].astype(np.float32), idf)[0]
    del got
    filled = x.any(axis=1)
    lang, x, fold = lang[filled], x[filled], fold[filled]
    langs, centroids = [], []
    for name in sorted(set(lang.tolist())):
        c = spherical_kmeans(x[lang == name], clusters)
        langs += [name] * len(c)
        centroids.append(c)
    if not langs:
        return None
    found = np.concatenate(centroids).astype(np.float32)
    return Model(langs, found, _floors(x, lang, fold, langs, found, clusters), idf)


def has_letter(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = (_FOLD[part] >= 97) & (_FOLD[part] < 123)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[own[1:]] > total[own[:-1]]
    for d in np.flatnonzero(~out & (np.diff(own) > 0)).tolist():
        out[d] = any(unicodedata.category(c)[0] == "L" for c in part[own[d] : own[d + 1]].tobytes().decode())
    return out


def _predict(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            *carried, texts = batch.columns
            for lo, hi, part, own in _sliced(texts):
                letter = has_letter(part, own)
                if m is None:
                    lang, score, out = ["und"] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                else:
                    lang, score, out = m.predict(gram_counts(part, own))
                    lang = [x if ok else "und" for x, ok in zip(lang, letter.tolist(), strict=True)]
                    score, out = np.where(letter, score, 0.0).astype(float), out | ~letter
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in carried), pa.array(lang), pa.array(score), pa.array(out)], names=names)

    return run


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected"), carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all but the text and namesakes) and language, cosine and rejection.

    Null texts and texts without a letter are `und`, with score 0, and rejected; so are all
    without a model. Equal texts get equal answers; no other column is looked at, and they
    may have any name.
    """
    carry = others(docs, text_col, *names) if carry is None else carry
    shape = shape_of(docs, carry, dict(zip(names, ("string", "double", "boolean"), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_rows(docs, text_col, carry).mapInArrow(_predict(shared, shape.names), shape)


def rejection(model: Model | None, spark=None):
    """A column function of a text column: whether the model rejects the text."""
    from pyspark.sql import SparkSession

    shared = (spark or SparkSession.active()).sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for _, _, part, own in _sliced(texts):
            no = ~has_letter(part, own)
            out.append(no | (m.predict(gram_counts(part, own))[2] if m else True))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return rejected


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
