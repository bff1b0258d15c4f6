"""From raw documents to packed training sequences.

Five stages, each over all that the one before it kept: language identification (what it
rejects goes), the n-gram Jaccard join (one document of each group stays), secret scans
(secrets are blanked), mixing of the sources to target weights (documents are taken as often
as the mix takes them), and best-fit packing into sequences. All but the last return the
columns they got. Empty tables, null texts and repeated rows pass through every stage as the
operators define it. Columns may have any name besides doc_id, text, lang, source and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join, language_id, mixing, packing, queries, secrets
from shelfwise.llm.tables import Scratch, fresh, named, release, stash
from shelfwise.sources.ship import ship

BLANK = "[REDACTED]"
#: SQL can express neither the learned nor the random stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the centroids learned from all labelled ones recognise."""
    ship(spark)
    model = language_id.fit(docs, F.lit(True))
    return docs.where(~language_id.rejection(model)(named("text").cast("string")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more."""
    ship(spark)
    return jaccard_join.keep_one(docs, k=5, percent=80)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced; n_chars follows the text where it changed."""
    ship(spark)
    (spans,) = fresh(docs, "secret_spans")
    found = secrets.scan(docs, redact=BLANK, spans_col=spans)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*map(named, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document (repeats too) lies in the training sequences."""
    ship(spark)
    return packing.packed(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("secret_scans", blank_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Scratch() as own:
            after = stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                own.keep(*own.frames)  # the result is read from them
                return after
            after = stash(after)
            own.keep(after)
        release(docs)  # the stage before has been read to its end
        docs = after
