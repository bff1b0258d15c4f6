"""From records to named categories, and placement of what is new."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cluster, naming, refine, tokens, vectors


@dataclass(frozen=True)
class Settings:
    """What decides a plan, with the values it is made with unless others are given."""

    clusters: int = 0  # 0: Ward's tree is cut at max_lists; k-means searches by silhouette
    algorithm: str = "agglomerative"  # or kmeans
    dims: int = 150
    min_df: int = 2
    max_df: float = 0.4
    max_vocab: int = 12_000
    restarts: int = 4
    min_cohesion: float = 0.36
    max_lists: int = 32
    merge_overlap: float = 0.3
    min_coverage: float = 0.15
    multi_list: int = 1
    multi_ratio: float = 0.8

    def check(self) -> None:
        if self.algorithm not in ("agglomerative", "kmeans"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}: agglomerative or kmeans")
        if self.max_lists < 1 or self.multi_list < 1:
            raise ValueError("max_lists and multi_list must be 1 at least")

    def table(self) -> dict[str, str]:
        """As a plan records them."""
        return {k: str(v) for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Plan:
    """categories (cluster, name, description, terms, lead, size, cohesion), members (row_id,
    cluster, sim, rank: 0 for the first cluster of a row) and unassigned (row_id)."""

    categories: DataFrame
    members: DataFrame
    unassigned: DataFrame
    settings: dict[str, str]


def embed(records: DataFrame, weights: tokens.Weights = tokens.Weights(), dims: int = 150, min_df: int = 2, max_df: float = 0.4, max_vocab: int = 12_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, bigrams, space (row_id, vec)) of records; rows without a known term are left out."""
    topics = records.select(F.explode("topics").alias("topic"))
    terms, pairs = tokens.weighted_terms(records, weights, tokens.topic_index(topics))
    terms = terms.persist()
    n = records.count()
    vocab = vectors.vocabulary(terms, n, min_df, max_df, max_vocab).persist()
    if not vocab.limit(1).count():
        raise ValueError("no term is left in the vocabulary: lower min_df or raise max_df")
    space = vectors.latent_space(vectors.tfidf(terms, vocab), vocab, dims)
    return terms, pairs, space.withColumnRenamed("doc_id", "row_id")


def written_forms(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((term, surface), (word, written, n)): how terms of descriptions are written, counted by distinct
    spelling, so that a stem is made once for each."""
    found = tokens.tallied(records, "pairs", text="description").persist()
    forms = found.groupBy(F.col("term").alias("surface")).agg(F.sum("n").alias("n"))
    surfaces = naming.modal(forms.withColumn("term", tokens.stem_of(forms, "surface")), "term", "surface").select("term", "surface")
    cased = naming.distinctive_casing(found.select(F.lower("raw").alias("word"), F.col("raw").alias("written"), "n"))
    return surfaces, cased


def make_plan(records: DataFrame, settings: Settings = Settings()) -> Plan:
    """Categories of records: embedded, clustered, refined, merged where named alike, without
    those their name does not cover, and with further lists for rows that are nearly as close."""
    settings.check()
    spark, s = records.sparkSession, settings
    records = tokens.spread(records).persist()
    terms, pairs, space = embed(records, dims=s.dims, min_df=s.min_df, max_df=s.max_df, max_vocab=s.max_vocab)
    space = space.persist()
    if s.algorithm == "kmeans":
        found = cluster.kmeans_best(space, s.clusters or cluster.search_k(space, 6, s.max_lists), s.restarts)
    else:
        found = cluster.ward(space, s.clusters or s.max_lists)
    members = space.join(found, "row_id").select("row_id", "cluster", "vec")
    refined = refine.refined(members, min_cohesion=s.min_cohesion, max_lists=s.max_lists).where("cluster is not null")
    now = refined.select(F.col("row_id").alias("doc_id"), "cluster").persist()
    sizes = dict(now.groupBy("cluster").count().collect())  # at most max_lists rows
    if not sizes:
        raise ValueError("no category survived refinement: lower min_cohesion or raise max_lists")
    surfaces, cased = (x.persist() for x in written_forms(records))
    weights = naming.weighed(terms, pairs).persist()

    def named(assigned: DataFrame) -> list[dict]:
        return naming.labels(naming.shares(naming.class_sums(weights, assigned)), surfaces, cased)

    def numbered(assigned: DataFrame, number: dict[int, int]) -> DataFrame:
        table = spark.createDataFrame(list(number.items()), "cluster int, number int")
        return assigned.join(F.broadcast(table), "cluster").select("doc_id", F.col("number").alias("cluster")).persist()

    per = naming.class_sums(weights, now).persist()
    now = numbered(now, naming.merged(per, sizes, surfaces, cased, s.merge_overlap))
    labels = named(now)
    if s.min_coverage > 0:
        leads = spark.createDataFrame([(x["cluster"], x["lead"]) for x in labels], "cluster int, lead string")
        held = weights.where("w > 0").select("doc_id", "term")
        covered = naming.name_coverage(now, held, leads).collect()  # a row a cluster
        kept = sorted((-r["size"], r["cluster"]) for r in covered if r["coverage"] >= s.min_coverage)
        if len(kept) < len(covered):
            number = {c: i for i, (_, c) in enumerate(kept)}
            now = numbered(now, number) if number else now.limit(0)
            labels = named(now)
    placed = space.join(now.withColumnRenamed("doc_id", "row_id"), "row_id").select("row_id", "cluster", "vec")
    centres = cluster.centroids(placed).persist()
    sims = cluster.similarities(placed, centres)
    members = sims.select("row_id", "cluster", "sim", F.lit(0).alias("rank"))
    if s.multi_list > 1:
        members = members.unionByName(refine.softened(placed, centres, s.multi_ratio, s.multi_list).select("row_id", "cluster", "sim", F.col("rank").cast("int").alias("rank")))
    table = spark.createDataFrame([(x["cluster"], x["name"], x["description"], x["terms"], x["lead"]) for x in labels], "cluster int, name string, description string, terms array<string>, lead string")
    categories = cluster.cohesions(sims).join(table, "cluster").select("cluster", "name", "description", "terms", "lead", "size", "cohesion")
    unassigned = records.select(F.col("doc_id").alias("row_id")).join(now.select(F.col("doc_id").alias("row_id")), "row_id", "left_anti")
    return Plan(categories, members, unassigned, s.table())


def build_plan(records: DataFrame, **settings) -> DataFrame:
    """The categories of `make_plan`."""
    return make_plan(records, Settings(**settings)).categories


def extend_plan(space: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (row_id, cluster, sim) for rows of `space` not in decided(row_id, cluster).

    Decided rows, unassigned ones (null cluster) too, keep what was decided; only newcomers
    are placed, by centroids of the decided members. Rows gone from the source vanish.
    """
    members = space.join(decided.where("cluster is not null"), "row_id").select("row_id", "cluster", "vec")
    new = space.join(decided.select("row_id"), "row_id", "left_anti")
    centres = cluster.centroids(members)
    return refine.placed(new, centres, refine.fit_floors(cluster.similarities(members, centres)))


def extended(space: DataFrame, listed: DataFrame, unassigned: DataFrame, prev: DataFrame, settings: Settings, kept: dict[str, str], made_at: str) -> Plan:
    """A plan brought up to date with rows that it has not decided on; nothing else moves.

    listed(row_id, cluster): memberships of the plan before, cluster the place of the category.
    A row's first category is its own, further ones are secondary and stay. Centroids are of
    all members, floors of first ones. Rows of `space` neither listed nor in unassigned(row_id)
    are placed, with further lists if `settings` says so; rows gone from `space` vanish.
    prev(cluster, name, description, terms, lead): names and descriptions stay as they are.
    The settings are those the plan was made with, `kept`, and what took part in placing.
    """
    if prev.isEmpty():
        raise ValueError("the plan has no categories to extend")
    first = listed.groupBy("row_id").agg(F.min("cluster").alias("own"))
    known = space.join(listed.distinct(), "row_id").join(first, "row_id").select("row_id", "cluster", "own", "vec")
    centres = cluster.centroids(known.select("row_id", "cluster", "vec")).persist()
    sims = cluster.similarities(known.select("row_id", "cluster", "vec"), centres)
    sims = sims.select("row_id", "cluster", "sim").join(first, "row_id").persist()
    fitted = refine.fit_floors(sims.where("cluster = own").select("row_id", "cluster", "sim"))
    floors = centres.select("cluster").join(fitted, "cluster", "left").select("cluster", F.coalesce("floor", F.lit(refine.MIN_SIM)).alias("floor"))
    decided = listed.select("row_id").union(unassigned.select("row_id")).distinct()
    new = space.join(decided, "row_id", "left_anti").select("row_id", "vec")
    found = refine.placed(new, centres, floors).persist()
    w = Window.partitionBy("row_id").orderBy("cluster")
    old = sims.select("row_id", "cluster", "sim", (F.row_number().over(w) - 1).cast("int").alias("rank"))
    members = old.unionByName(found.select("row_id", "cluster", "sim", F.lit(0).alias("rank")))
    if settings.multi_list > 1:
        more = refine.softened(new.join(found, "row_id").select("row_id", "cluster", "vec"), centres, settings.multi_ratio, settings.multi_list)
        members = members.unionByName(more.select("row_id", "cluster", "sim", F.col("rank").cast("int").alias("rank")))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("sim").alias("cohesion"))
    cats = prev.select("cluster", "name", "description", "terms", "lead").join(sizes, "cluster")
    left = space.select("row_id").join(members.select("row_id").distinct(), "row_id", "left_anti")
    noted = {"incremental": "true", "incremental-from": made_at, "place-multi-list": str(settings.multi_list), "place-multi-list-ratio": str(settings.multi_ratio)}
    return Plan(cats, members, left, kept | noted)
