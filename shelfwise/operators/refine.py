"""Refinement of a clustering and placement of new rows.

Members are rows (row_id, cluster, vec), cluster null when unassigned; centres are rows
(cluster, vec). Every tie goes to the lower id. Similarities are compared at nine decimals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import SIMS, centroids, cohesions, similarities
from .vectors import dot, matrix_or_nan


MIN_SIM = 0.05
BLOCK = 1 << 15  # rows of a block at most, by and large


def fit_floors(sims: DataFrame, min_sim: float = MIN_SIM, sigmas: float = 3.0) -> DataFrame:
    """Rows (cluster, floor): below it a member is an outlier.

    With four members and some spread: max(min_sim, min(median - sigmas * MAD, median - 0.4
    |median|)); else min_sim.
    """
    med = sims.groupBy("cluster").agg(F.expr("percentile(sim, 0.5)").alias("med"), F.count("*").alias("n"))
    mad = sims.join(med, "cluster").groupBy("cluster", "med", "n").agg(F.expr("percentile(abs(sim - med), 0.5)").alias("mad"))
    low = F.least(F.col("med") - sigmas * F.col("mad"), F.col("med") - 0.4 * F.abs("med"))
    use = F.lit(sigmas > 0) & (F.col("n") >= 4) & (F.col("mad") >= 1e-6)
    return mad.select("cluster", F.when(use, F.greatest(F.lit(min_sim), low)).otherwise(F.lit(min_sim)).alias("floor"), "med", "mad", "n")


def outliers(sims: DataFrame, floors: DataFrame) -> DataFrame:
    return sims.join(floors.select("cluster", "floor"), "cluster").where("sim < floor").select("row_id", "cluster", "sim", "floor")


def nearest(rows: DataFrame, centres: DataFrame, where=None) -> DataFrame:
    """Rows (row_id, cluster, sim): the best centroid of each row among those that pass.

    Centroids are few by design, but their size is left to the planner to check.
    """
    pairs = rows.select("row_id", "vec").join(centres.withColumnRenamed("vec", "centre"), how="cross").withColumn("sim", dot("vec", "centre"))
    pairs = pairs if where is None else pairs.where(where)
    best = Window.partitionBy("row_id").orderBy(F.desc(F.round("sim", 9)), "cluster")
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("row_id", "cluster", "sim")


def neighbours(rows: DataFrame, assigned: DataFrame, k: int = 10, most: int | None = None) -> DataFrame:
    """Rows (row_id, other, cluster, sim): the k assigned rows nearest to each row.

    Blocks of both are multiplied, each pair of blocks in a group of its own that keeps its
    k nearest. `most` bounds the number of either; without it both are counted.
    """
    spark = rows.sparkSession
    few, many = (max(most if most is not None else x.count(), 1) for x in (rows, assigned))
    tasks = 2 * spark.sparkContext.defaultParallelism
    # what is sent is rows * parts + assigned * cuts: least, for so many groups, where both are alike
    parts = max(-(-many // BLOCK), min(many, int(np.ceil(np.sqrt(tasks * many / few)))))
    cuts = max(-(-few // BLOCK), min(few, -(-tasks // parts)))
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((rows, "row_id"), (assigned, "cluster"))}
    other = assigned.schema["row_id"].dataType.simpleString()
    hashed = lambda n: F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("row_id", "vec", hashed(cuts).alias("cut")).select("*", every(parts).alias("part"))
    # columns of the two sides are told apart by their identity: those of one side are made anew
    b = assigned.select(*[F.col(c).alias(c) for c in ("row_id", "cluster", "vec")], hashed(parts).alias("part")).select("*", every(cuts).alias("cut"))

    ids = rows.select("row_id").limit(0).toArrow()
    none = assigned.select(F.col("row_id").alias("other"), "cluster", F.lit(0.0).alias("sim")).limit(0).toArrow().add_column(0, "row_id", ids.column(0))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none
        b = b.take(pc.sort_indices(b.column("row_id")))  # so that places are in the order of ids
        x, y = matrix_or_nan(a.column("vec")), matrix_or_nan(b.column("vec"))
        found = []
        step = max(1, SIMS // len(y))
        for lo in range(0, len(x), step):
            sim = x[lo : lo + step] @ y.T
            key = np.floor(sim * 1e9 + 0.5)
            key[np.isnan(key)] = -np.inf
            least = np.partition(key, -k, axis=1)[:, -k] if k < len(y) else np.full(len(key), -np.inf)
            at, to = np.nonzero(key >= least[:, None])
            order = np.lexsort((to, -key[at, to], at))
            at, to = at[order], to[order]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((at[kept] + lo, to[kept], sim[at[kept], to[kept]]))
        at, to, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        sims = pa.array(sim, mask=np.isnan(sim))
        return pa.table({"row_id": a.column("row_id").take(pa.array(at)), "other": b.column("row_id").take(pa.array(to)), "cluster": b.column("cluster").take(pa.array(to)), "sim": sims})

    pairs = a.groupBy("cut", "part").cogroup(b.groupBy("cut", "part")).applyInArrow(near, f"row_id {kinds['row_id']}, other {other}, cluster {kinds['cluster']}, sim double")
    w = Window.partitionBy("row_id").orderBy(F.desc(F.floor(F.col("sim") * 1e9 + 0.5)), "other")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def rescued(near: DataFrame, agreement: float = 0.8) -> DataFrame:
    """Rows (row_id, cluster, votes, found): unassigned rows whose neighbours agree."""
    agreement = agreement if agreement > 0 else 0.6
    votes = near.groupBy("row_id", "cluster").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("row_id")
    top = votes.withColumn("found", F.sum("votes").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("votes"), "cluster")))
    return top.where(F.expr("r = 1") & (F.col("votes") >= agreement * F.col("found") - 1e-9)).drop("r")


def survivors(sizes: DataFrame, min_size: int = 4, min_cohesion: float = 0.36, max_lists: int = 32) -> DataFrame:
    """Clusters (cluster, size, cohesion) that are large and close enough, the largest first."""
    good = sizes.where((F.col("size") >= min_size) & (F.round("cohesion", 9) >= min_cohesion))
    return good.orderBy(F.desc("size"), "cluster").limit(max_lists) if max_lists > 0 else good


def rehomed(rows: DataFrame, centres: DataFrame, kept: DataFrame, min_sim: float = 0.05) -> DataFrame:
    """Rows (row_id, cluster, sim) that find a surviving cluster at 0.6 of its cohesion."""
    good = centres.select("cluster", "vec").join(kept.select("cluster", "cohesion"), "cluster")
    ok = (F.col("sim") > min_sim) & (F.col("sim") >= F.greatest(F.lit(min_sim), 0.6 * F.col("cohesion")))
    return nearest(rows, good, ok)


def renumbered(sizes: DataFrame) -> DataFrame:
    """Rows (cluster, number): 0, 1, ... by size, then by the old number; clusters are few."""
    return sizes.select("cluster", "size", (F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1).alias("number"))


def softened(members: DataFrame, centres: DataFrame, ratio: float = 0.8, most: int = 2) -> DataFrame:
    """Rows (row_id, cluster, sim, rank): further clusters nearly as close as the own one."""
    own = similarities(members, centres).select("row_id", F.col("cluster").alias("own"), (ratio * F.col("sim")).alias("floor"))
    pairs = members.select("row_id", "vec").join(own, "row_id").join(centres.select("cluster", F.col("vec").alias("centre")), F.col("cluster") != F.col("own"))
    near = pairs.withColumn("sim", dot("vec", "centre")).where("floor > 0 and sim >= floor")
    w = Window.partitionBy("row_id").orderBy(F.desc(F.round("sim", 9)), "cluster")
    return near.select("row_id", "cluster", "sim", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most - 1)


def placed(new_rows: DataFrame, centres: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows (row_id, cluster, sim): newcomers in their nearest cluster, if they reach its floor.

    Only the nearest cluster is tried; nothing else moves.
    """
    best = nearest(new_rows, centres.select("cluster", "vec"))
    return best.join(floors.select("cluster", "floor"), "cluster").where("sim >= floor").select("row_id", "cluster", "sim")


def split_weak(members: DataFrame, sizes: DataFrame, parts: int = 3, most: int = 200, least: int = 40, min_cohesion: float = 0.36, min_size: int = 4) -> DataFrame:
    """Rows (row_id, cluster, part): weak or oversized clusters cut by Ward into 2..parts.

    The number of parts that places most members in valid parts wins; parts that are too
    small or loose release their members (part null); an oversized cluster that is not weak
    is cut only if nine tenths stay placed. Clusters are cut in parallel, one task each.
    """
    import pandas as pd

    from .cluster import cut_tree, ward_tree

    kind = members.schema["row_id"].dataType.simpleString()
    weak = F.col("cohesion") < min_cohesion
    todo = sizes.where((weak | (F.col("size") > most)) & (F.col("size") >= least)).select("cluster", weak.alias("weak"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x = np.array(pdf["vec"].tolist())
        merges, best = ward_tree(x), (-1, None)
        for k in range(2, parts + 1):
            label = cut_tree(merges, len(x), k)
            part = np.full(len(x), -1)
            for c in range(k):
                own = x[label == c]
                mean = own.sum(axis=0)
                fit = float((own @ (mean / max(np.linalg.norm(mean), 1e-12))).mean()) if len(own) else 0.0
                if len(own) >= min_size and fit >= min_cohesion:
                    part[label == c] = c
            if (part >= 0).sum() > best[0]:
                best = (int((part >= 0).sum()), part)
        enough = best[0] > 0 and (bool(pdf["weak"].iloc[0]) or best[0] >= 0.9 * len(x))
        part = pd.array(best[1] if enough else np.zeros(len(x), int), dtype="Int32")
        part[np.asarray(part) < 0] = pd.NA
        return pd.DataFrame({"row_id": pdf["row_id"], "cluster": pdf["cluster"], "part": part})

    return members.join(todo, "cluster").select("row_id", "cluster", "vec", "weak").groupBy("cluster").applyInPandas(cut, f"row_id {kind}, cluster int, part int")


def refined(members: DataFrame, min_sim: float = 0.05, sigmas: float = 3.0, k: int = 10, agreement: float = 0.8, min_size: int = 4, min_cohesion: float = 0.36, max_lists: int = 32, split_parts: int = 3, split_above: int = 200, split_least: int = 40) -> DataFrame:
    """Rows (row_id, cluster): two outlier passes, splits, neighbour rescue, then dissolving
    and rehoming until every cohesion holds (five passes at most), numbered by size.

    Members are kept in memory between passes and cut from their lineage by checkpoints when
    the session has a checkpoint folder.
    """
    def settle(df: DataFrame) -> DataFrame:
        has = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
        return df.checkpoint() if has else df.persist()

    space, now, rejected = members.select("row_id", "vec"), settle(members), None
    for _ in range(2):
        sims = similarities(now, centroids(now))
        out = settle(outliers(sims, fit_floors(sims, min_sim, sigmas)).select("row_id"))
        rejected = out if rejected is None else rejected.union(out)
        now = settle(now.join(out.withColumn("gone", F.lit(True)), "row_id", "left").select("row_id", F.when(F.col("gone").isNull(), F.col("cluster")).alias("cluster"), "vec"))
    if split_parts >= 2 and min_cohesion > 0:
        sizes = cohesions(similarities(now, centroids(now)))
        cut = split_weak(now.where("cluster is not null"), sizes, split_parts, split_above, split_least, min_cohesion, min_size)
        top = now.agg(F.max("cluster")).head()[0] or 0
        new = cut.select("row_id", F.when(F.col("part").isNull(), F.lit(None)).when(F.col("part") == 0, F.col("cluster")).otherwise((top + 1) * F.col("part") + F.col("cluster")).cast("int").alias("to"), F.lit(True).alias("cut"))
        now = settle(now.join(new, "row_id", "left").select("row_id", F.when(F.col("cut"), F.col("to")).otherwise(F.col("cluster")).alias("cluster"), "vec"))
    near = neighbours(now.where("cluster is null"), now.where("cluster is not null"), k)
    back = rescued(near, agreement).select("row_id", F.col("cluster").alias("to"))
    now = settle(now.join(back, "row_id", "left").select("row_id", F.coalesce("cluster", "to").alias("cluster"), "vec"))
    for _ in range(5):
        centres = centroids(now)
        sizes = settle(cohesions(similarities(now, centres)))
        kept = survivors(sizes, min_size, min_cohesion, max_lists)
        if kept.count() == sizes.count():
            break
        stay = now.join(kept.select("cluster"), "cluster", "left_semi").select("row_id", "cluster")
        free = space.join(stay, "row_id", "left_anti").join(rejected, "row_id", "left_anti")
        moved = rehomed(free, centres, kept, min_sim).select("row_id", "cluster")
        now = settle(space.join(stay.unionByName(moved), "row_id", "left").select("row_id", "cluster", "vec"))
    sizes = now.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
    return now.join(renumbered(sizes), "cluster", "left").select("row_id", F.col("number").alias("cluster"))
