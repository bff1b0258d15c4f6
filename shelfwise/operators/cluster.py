"""Clustering of dense vector spaces: rows (row_id, vec array<double>), unit length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import dot, matrix, matrix_or_nan

WARD_ROWS = 12_000  # points that Ward's tree is built over at most: 4 bytes for each pair of them


PAIR_ROWS = 1_536  # rows of a block, whose pairs with another block are one group
SIMS = 1 << 21  # similarities held at once


def pair_distances(space: DataFrame) -> DataFrame:
    """Rows (i, j, distance) for i < j: max(0, 2 (1 - cosine)) in single precision.

    Blocks of rows are multiplied, each pair of blocks in a group of its own.
    """
    kind = space.schema["row_id"].dataType.simpleString()
    n = -(-space.count() // PAIR_ROWS) or 1
    block = F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    rows = space.where("row_id is not null").select("row_id", "vec", block.alias("own"))
    # columns of the two sides are told apart by their identity: those of one side are made anew
    low = rows.select("row_id", "vec", F.col("own").alias("lo"), F.explode(F.sequence("own", F.lit(n - 1))).alias("hi"))
    high = rows.select(F.col("row_id").alias("row_id"), F.col("vec").alias("vec"), F.explode(F.sequence(F.lit(0), "own")).alias("lo"), F.col("own").alias("hi"))

    none = space.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(0.0).cast("float").alias("distance")).limit(0).toArrow()

    def pairs(key, a, b):
        if not a.num_rows or not b.num_rows:
            return none
        ids = pa.chunked_array([*a.column("row_id").chunks, *b.column("row_id").chunks]).combine_chunks()
        x, y = (matrix_or_nan(t.column("vec")) for t in (a, b))
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        below = rank[: len(x), None] < rank[None, len(x) :]
        wanted = below if key[0].as_py() == key[1].as_py() else rank[: len(x), None] != rank[None, len(x) :]
        at, to = np.nonzero(wanted)
        d = np.fmax(0, 2 * (1 - x @ y.T)).astype(np.float32)[wanted]  # fmax: 0 where a vector is missing
        up = below[wanted]
        first, second = np.where(up, at, to + len(x)), np.where(up, to + len(x), at)
        return pa.table({"i": ids.take(pa.array(first)), "j": ids.take(pa.array(second)), "distance": pa.array(d)})

    return low.groupBy("lo", "hi").cogroup(high.groupBy("lo", "hi")).applyInArrow(pairs, f"i {kind}, j {kind}, distance float")


def centroids(members: DataFrame) -> DataFrame:
    """Rows (cluster, vec, size) from (row_id, cluster, vec): normalised sums by cluster."""
    cells = members.where("cluster is not null").select("cluster", F.posexplode("vec").alias("dim", "x"))
    sums = cells.groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("size"))
    vec = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("v"), F.max("size").alias("size"))
    norm = F.sqrt(dot("v", "v"))
    return vec.select("cluster", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vec"), "size")


def similarities(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows (row_id, cluster, sim): each assigned row against its own centroid."""
    return members.join(centres.select("cluster", F.col("vec").alias("centre")), "cluster").select("row_id", "cluster", dot("vec", "centre").alias("sim"))


def cohesions(sims: DataFrame) -> DataFrame:
    return sims.groupBy("cluster").agg(F.avg("sim").alias("cohesion"), F.count("*").alias("size"))


def sampled(space: DataFrame, cap: int, seed: int = 1) -> DataFrame:
    """At most `cap` rows by a hash of the id; all when cap <= 0."""
    return space if cap <= 0 else space.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(cap)


def silhouette(members: DataFrame) -> DataFrame:
    """One row (score, n): mean silhouette by cosine distance.

    Rows alone in their cluster, and rows without another cluster, are left out; the score
    is null when none is left. The mean distance to a cluster follows from the sum of its
    vectors, without what has the row's own id, so no pairs of rows are made; means below
    1e-12 are what rounding leaves and count as 0.
    """
    known = members.where("cluster is not null and vec is not null")
    a = known.select(F.col("row_id").alias("i"), F.col("cluster").alias("ci"), F.col("vec").alias("a"))
    b = known.select(F.col("row_id").alias("j"), F.col("cluster").alias("cj"), F.col("vec").alias("b"))
    cells = b.select("cj", F.posexplode("b").alias("dim", "x")).groupBy("cj", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"])
    sums = cells.groupBy("cj").agg(total.alias("total"), F.max("n").alias("n"))
    every = a.join(sums, how="cross").select("i", "ci", "cj", "n", (F.col("n") - dot("a", "total")).alias("d"))
    itself = a.join(b, F.col("i") == F.col("j")).select("i", "ci", "cj", F.lit(-1).alias("n"), (dot("a", "b") - 1).alias("d"))
    mean = every.unionByName(itself).groupBy("i", "ci", "cj").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("n > 0")
    mean = mean.select("i", "ci", "cj", F.when(F.abs(F.col("d") / F.col("n")) < 1e-12, 0.0).otherwise(F.col("d") / F.col("n")).alias("d"))
    per = mean.groupBy("i").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("own"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("other"))
    usable = per.where("own is not null and other is not null and greatest(own, other) > 0")
    return usable.agg(F.avg((F.col("other") - F.col("own")) / F.greatest("own", "other")).alias("score"), F.count("*").alias("n"))


def ward_tree(vectors: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Merges (a, b, height) of Ward's method by nearest-neighbour chains, b kept under a's slot.

    Distances are 2 (1 - cosine), updated by Lance and Williams in single precision; weights
    are the sizes that rows start with.
    """
    n = len(vectors)
    size = np.ones(n) if weights is None else weights.astype(float).copy()
    d = np.empty((n, n), np.float32)
    for lo in range(0, n, 512):
        some = slice(lo, lo + 512)
        part = np.maximum(0, 2 * (1 - vectors[some] @ vectors.T))
        if weights is not None:
            part *= 2 * size[some, None] * size[None, :] / (size[some, None] + size[None, :])
        d[some] = part
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            x = chain[-1]
            row = d[x]
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain = chain[:-2]
        a, b = min(x, y), max(x, y)
        height = float(d[a, b])
        merges.append((a, b, height))
        total = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
        new[~alive] = np.inf
        d[a] = d[:, a] = new.astype(np.float32)
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        alive[b] = False
        size[a] += size[b]
    return np.array(merges).reshape(-1, 3)


def cut_tree(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Cluster of each row for k clusters, numbered by their least row; merges by height."""
    k = min(max(k, 1), max(n, 1))
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left = n
    for at in np.lexsort((np.arange(len(merges)), merges[:, 2])) if len(merges) else ():
        if left <= k:
            break
        a, b = sorted((root(int(merges[at, 0])), root(int(merges[at, 1]))))
        if a != b:
            up[b] = a
            left -= 1
    numbers: dict[int, int] = {}
    return np.array([numbers.setdefault(root(i), len(numbers)) for i in range(n)], int)


def ward(space: DataFrame, k: int) -> DataFrame:
    """Rows (row_id, cluster): weighted Ward over points that stand for rows.

    The method needs all distances, so its tree is built in one task over WARD_ROWS points at
    most. Up to as many rows each is a point of its own; of more, spherical k-means makes the
    points, a twentieth as many as rows, each with the weight of its members.
    """
    n = space.count()
    kind = space.schema["row_id"].dataType.simpleString()

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("point")
        x = np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)
        weights = pdf["size"].to_numpy(float)
        tree = ward_tree(x, None if (weights == 1).all() else weights)
        return pd.DataFrame({"point": pdf["point"].to_numpy(), "cluster": cut_tree(tree, len(x), k)})

    if n <= WARD_ROWS:
        points = space.select(F.col("row_id").alias("point"), "vec", F.lit(1).alias("size"), F.lit(0).alias("all"))
        return points.groupBy("all").applyInPandas(build, f"point {kind}, cluster int").withColumnRenamed("point", "row_id")
    micro, centres = kmeans(space, min(WARD_ROWS, max(k, n // 20)), rounds=5)
    points = centres.where("size > 0").select(F.col("cluster").alias("point"), "vec", "size", F.lit(0).alias("all"))
    found = points.groupBy("all").applyInPandas(build, "point int, cluster int")
    return micro.withColumnRenamed("cluster", "point").join(found, "point").select("row_id", "cluster")


def best(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, similarity) of the first best centre of each row; SIMS similarities are held at once."""
    own, sim = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, SIMS // len(centres))
    for lo in range(0, len(vectors), step):
        s = vectors[lo : lo + step] @ centres.T
        own[lo : lo + step] = at = np.argmax(s, axis=1)
        sim[lo : lo + step] = s[np.arange(len(s)), at]
    return own, sim


def kmeans(space: DataFrame, k: int, seed: int = 1, rounds: int = 60, start_rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """((row_id, cluster), (cluster, vec, size)): spherical k-means.

    Starts by k-means++ on a hash sample (`start_rows`, k * 4 at least); each round is one
    pass that sends one sum for each cluster of a task. Clusters left empty take the
    worst-fitting rows.
    """
    spark = space.sparkSession
    rng = np.random.default_rng(seed)
    x = matrix(sampled(space, max(start_rows, 4 * k), seed).orderBy("row_id").select("vec").toArrow().column("vec").combine_chunks())
    k = min(k, len(x))
    kind = space.schema["row_id"].dataType.simpleString()
    if k == 0:
        return spark.createDataFrame([], f"row_id {kind}, cluster int"), spark.createDataFrame([], "cluster int, vec array<double>, size long")
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]  # similarity with the nearest start
    for _ in range(k - 1):
        far = np.maximum(0, 1 - near) ** 2
        chosen.append(int(rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()

    def sums(shared):
        def run(batches):
            total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column("vec"))
                    own = best(v, shared.value)[0]
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0]))
                    total[own[order][first]] += np.add.reduceat(v[order], first)
                    count += np.bincount(own, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([t.tobytes() for t in total[some]], pa.binary()), pa.array(count[some])], names=["cluster", "total", "size"])

        return run

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer()) for b in table.column("total"))
        return pa.table({"cluster": table.column("cluster")[:1], "total": pa.array([total.tobytes()], pa.binary()), "size": pa.array([int(table.column("size").to_numpy().sum())])})

    def placed_by(shared):
        def run(batches):
            for batch in batches:
                own, sim = best(matrix(batch.column("vec")), shared.value)
                yield pa.record_batch([batch.column("row_id"), pa.array(own.astype(np.int32)), pa.array(sim)], names=["row_id", "cluster", "sim"])

        return run

    shape = "cluster int, total binary, size long"
    shared = spark.sparkContext.broadcast(c)
    for _ in range(rounds):
        new, empty = c.copy(), np.ones(len(c), bool)
        per = space.select("vec").mapInArrow(sums(shared), shape).groupBy("cluster").applyInArrow(added, shape)
        for r in per.collect():  # one row a cluster
            v = np.frombuffer(bytes(r["total"]))
            norm = np.linalg.norm(v)
            new[r["cluster"]] = v / norm if norm > 0 else c[r["cluster"]]
            empty[r["cluster"]] = False
        if empty.any():
            worst = space.select("row_id", "vec").mapInArrow(placed_by(shared), f"row_id {kind}, cluster int, sim double").orderBy("sim", "row_id").limit(int(empty.sum()))
            rows = space.join(worst, "row_id").orderBy("sim", "row_id").select("vec").collect()
            for j, r in zip(np.flatnonzero(empty).tolist(), rows, strict=False):
                new[j] = np.array(r["vec"])
        same = np.allclose(new, c, atol=1e-12)
        c = new
        shared = spark.sparkContext.broadcast(c)
        if same:
            break
    placed = space.select("row_id", "vec").mapInArrow(placed_by(shared), f"row_id {kind}, cluster int, sim double")
    found = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    table = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(c)], "cluster int, vec array<double>")
    return placed.select("row_id", "cluster"), table.join(found, "cluster", "left").select("cluster", "vec", F.coalesce("size", F.lit(0)).alias("size"))


def kmeans_best(space: DataFrame, k: int, restarts: int = 4, seed: int = 1) -> DataFrame:
    """The best of several runs by mean cosine; of equal ones the first."""
    best = None
    for r in range(restarts):
        placed, centres = kmeans(space, k, seed + 7919 * r + 104729 * k)
        score = similarities(space.join(placed, "row_id"), centres).agg(F.avg("sim")).head()[0] or 0.0
        if best is None or score > best[0]:
            best = (score, placed)
    return best[1]


def consensus(space: DataFrame, k: int, runs: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """((row_id, cluster), (cluster, vec, size), mean similarity): k-means of the agreement space.

    A row is there one indicator for each of its clusters in `runs` runs; centroids and the
    score are those of the rows' own vectors.
    """
    marks = None
    for r in range(runs):
        placed, _ = kmeans(space, k, seed + 7919 * r)
        part = placed.select("row_id", (F.col("cluster") + r * k).alias("dim"))
        marks = part if marks is None else marks.unionByName(part)
    one = float(1 / np.sqrt(runs))
    held = marks.groupBy("row_id").agg(F.collect_set("dim").alias("dims"))
    indicator = F.transform(F.sequence(F.lit(0), F.lit(runs * k - 1)), lambda d: F.when(F.array_contains("dims", d), one).otherwise(0.0))
    found = kmeans(held.select("row_id", indicator.alias("vec")).persist(), k, seed)[0].persist()
    members = space.join(found, "row_id").select("row_id", "cluster", "vec")
    centres = centroids(members)
    return found, centres, similarities(members, centres).agg(F.avg("sim")).head()[0] or 0.0


def search_k(space: DataFrame, low: int, high: int, sample: int = 600, seed: int = 1) -> int:
    """The number of clusters of the best sampled silhouette, in steps of ceil(span / 14)."""
    n = space.count()
    low, high = min(low, n), min(high, n)
    step, best = max(1, -(-(high - low) // 14)), (None, low)
    for k in range(low, high + 1, step):
        placed, _ = kmeans(space, k, seed)
        score = silhouette(sampled(space.join(placed, "row_id"), sample, seed)).head()[0]
        if score is not None and (best[0] is None or score > best[0]):
            best = (score, k)
    return best[1]
