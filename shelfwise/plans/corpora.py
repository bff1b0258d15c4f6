"""The engine's logical inputs, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.naming import MARKER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records with times, stars and flags."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws("/", "o_orderpriority", F.concat(F.lit("order-"), F.col("o_custkey").cast("string"))).alias("full_name"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("stars"),
        (F.col("o_orderstatus") == "F").alias("fork"),
        (F.col("o_orderstatus") == "P").alias("archived"),
        F.col("o_orderdate").alias("starred_at"),
        F.col("o_orderdate").alias("pushed_at"),
    )


def part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with topics; PROMO parts have none."""
    p = table(spark, sf_dir, "part")
    topics = F.when(F.col("p_type") == "PROMO", F.array().cast("array<string>")).otherwise(F.array(F.translate("p_name", " ", "-"), F.lower("p_type")))
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), topics.alias("topics"), F.col("p_size").alias("stars"))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("owner"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("language"), F.col("text").alias("description"), F.array().cast("array<string>").alias("topics"))


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their labels as clusters."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vec"))


def remote(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wanted, lists, memberships): documents filed by language, and a state behind it.

    The state lacks short documents, holds very short ones in the list `en` whatever their
    language, and has a managed list for each source that the plan does not have; the list
    `es` is hand-made.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.concat_ws("/", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("full_name"))
    wanted = d.select(F.col("lang").alias("category"), "full_name")
    mark = F.when(F.col("name") == "ES", "kept by hand").otherwise(F.concat(F.lit("List. "), F.lit(MARKER)))
    by_lang = d.groupBy(F.upper("lang").alias("name")).agg(F.count("*").alias("count"))
    by_source = d.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("count"))
    lists = by_lang.unionByName(by_source).select(F.concat(F.lit("L-"), F.lower("name")).alias("list_id"), "name", mark.alias("description"), "count")
    filed = d.where("n_chars >= 1000").select(F.concat(F.lit("L-"), "lang").alias("list_id"), "full_name")
    astray = d.where("n_chars < 300").select(F.lit("L-en").alias("list_id"), "full_name")
    return wanted, lists, filed.unionByName(astray).distinct()
