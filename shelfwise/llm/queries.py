"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, mixing, packing, quality, secrets, sharding, suffix_dedup, token_counts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_docs(spark, sf_dir), k=4, percent=85, counting=True)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_docs(spark, sf_dir), 16)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.length("text").cast("long").alias("n_characters"))
    return token_counts.with_token_counts(docs, tokenizer_file("piece_bpe_32k.model"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judged(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup.without_repeats(docs, 200).drop("kept")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_docs(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = secrets.joined_spans("secret_spans", ("assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined_spans("secret_spans", secrets.KINDS).alias("spans"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_docs(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = language_id.fit(docs, ~language_id.held_out())
    base = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.identified(base, model)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(mixing.document_sizes(_docs(spark, sf_dir)))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_sharding,
        op3_token_counts,
        op4_best_fit_packing,
        op5_quality_rules,
        op6_suffix_dedup,
        op7_secret_scans,
        op8_document_fingerprints,
        op9_language_id,
        op10_mixing_sources,
    )
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n, list(g order by g) as gs from s group by 1),
cls as (select doc_id, min(doc_id) over (partition by gs) as class_id from n),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select a as u, b as v from l union select r.u, l.b from r join l on r.v = l.a),
m as (select u, min(v) as v from r group by 1),
k as (select l.a as doc_id, count(distinct y.class_id) as n_links from l join cls x on x.doc_id = l.a join cls y on y.doc_id = l.b where x.class_id <> y.class_id group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) as component_id, coalesce(cls.class_id, d.doc_id) as class_id, coalesce(k.n_links, 0) as n_links
from documents d left join n using (doc_id) left join cls using (doc_id) left join m on m.u = d.doc_id left join k on k.doc_id = d.doc_id""",
}
