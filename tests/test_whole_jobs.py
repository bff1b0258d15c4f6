"""Texts and vectors that the given tables lack, held against each query's SQL or by brute force."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shelfwise.functions import lexis, udfs
from shelfwise.operators import cluster as C
from shelfwise.operators import naming, refine, tokens, vectors, weights
from shelfwise.plans.pipeline import written_forms

ODD = ["", "---", "https://only.an/address", None, "ÀbcDef k8sPod HTTPServerPool x²y ½z ⅧaB", "пРивет МирДа v12 c++ 3", "Node.js\tnode.js,C# .NET a a b a"]


def against_sql(spark, tmp_path, name, places=6, **tables):
    """The query's rows and those of its SQL over the given (columns, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    near = lambda x: round(x, places - 1) if isinstance(x, float) else x
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    r = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    return Counter(tuple(map(near, x)) for x in df.collect()), Counter(tuple(near(x[i]) for i in at) for x in r.fetchall())


def odd_documents(copies=1):
    texts = [t for _ in range(copies) for t in [*ODD, "Common words of MyOwn making", "common MyOwn words and more words", "API API API of words"]]
    return "doc_id long, text string, lang string", [(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)]


def test_camel_tokens_of_odd_texts(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "camel_tokens", documents=odd_documents())
    assert got == want and ("", 3) in got


def vectors_of(n, seed=1, dims=6, clusters=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[1::7] = x[0::7][: len(x[1::7])]  # equal vectors under several ids
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return "row_id long, cluster int, vec array<double>", [(int(7 * i % 1009), int(rng.integers(clusters)), [float(v) for v in r]) for i, r in enumerate(x)]


def kinds_of_plan(df):
    """What the plan is made of."""
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [7, 64, 1_536])
def test_pairs_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(C, "PAIR_ROWS", block)
    schema, rows = vectors_of(60)
    df = C.pair_distances(spark.createDataFrame(rows, schema))
    want = {(a[0], b[0]): max(0, 2 * (1 - np.dot(a[2], b[2]))) for a in rows for b in rows if a[0] < b[0]}
    got = {(r["i"], r["j"]): r["distance"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert "Join" not in kinds_of_plan(df)


def test_silhouette_makes_no_pairs(spark):
    schema, rows = vectors_of(80)
    rows += [(rows[0][0], rows[1][1], rows[2][2]), (2_000, None, rows[3][2]), (2_001, 3, None)]  # an id twice, no cluster, no vector
    got = C.silhouette(spark.createDataFrame(rows, schema))
    per = {}
    for i, ci, a in rows:
        for j, cj, b in rows:
            if i != j and ci is not None and cj is not None and a and b:
                per.setdefault(i, {}).setdefault((ci, cj), []).append(1 - np.dot(a, b))
    scores = []
    for d in per.values():
        own = [np.mean(v) for (ci, cj), v in d.items() if ci == cj]
        other = [np.mean(v) for (ci, cj), v in d.items() if ci != cj]
        if own and other:
            scores.append((min(other) - min(own)) / max(min(own), min(other)))
    r = got.head()
    assert r["n"] == len(scores) and abs(r["score"] - np.mean(scores)) < 1e-9
    assert "NOT (i#" not in kinds_of_plan(got)


@pytest.mark.parametrize("block", [8, 1 << 15])
def test_neighbours_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(refine, "BLOCK", block)
    schema, rows = vectors_of(90, seed=2)
    df = spark.createDataFrame(rows, schema)
    near = refine.neighbours(df.where("cluster = 0"), df.where("cluster > 0"), 5)
    got = {}
    for r in near.collect():
        got.setdefault(r["row_id"], []).append((r["other"], r["cluster"]))
    for i, _, a in (r for r in rows if r[1] == 0):
        best = sorted((-round(float(np.dot(a, b)), 9), j, c) for j, c, b in rows if c > 0)[:5]
        assert sorted(got[i]) == sorted((j, c) for _, j, c in best)
    assert "Join" not in kinds_of_plan(near)


def test_best_centres_hold_few_similarities(monkeypatch):
    x = np.random.default_rng(0).standard_normal((50, 4))
    monkeypatch.setattr(C, "SIMS", 30)
    own, sim = C.best(x, x[:9])
    assert (own == np.argmax(x @ x[:9].T, axis=1)).all() and np.allclose(sim, (x @ x[:9].T).max(axis=1))


COUNTED = ["normalized_terms", "bigrams", "vocab_prune", "vocab_cap", "display_forms", "distinctive_casing", "ctfidf_terms", "label_jaccard", "name_coverage"]


@pytest.mark.parametrize("kept", [4, 200_000])
@pytest.mark.parametrize("name", COUNTED)
def test_counts_of_odd_texts(spark, tmp_path, monkeypatch, name, kept):
    monkeypatch.setattr(lexis, "KEPT", kept)  # how often counts go out changes nothing
    got, want = against_sql(spark, tmp_path, name, documents=odd_documents(2))
    assert got == want and got


def test_counts_go_out_by_distinct_word(spark):
    """Tasks count while they read: no row for each occurrence is exchanged or sorted."""
    docs = spark.createDataFrame([(i, "same words again and again " * 200) for i in range(50)], "doc_id long, text string")
    for of in tokens.ITEMS:
        df = tokens.tallies(docs, of)
        assert df.count() < 50 * 8 and "Window" not in kinds_of_plan(df)


def test_page_terms_of_odd_texts(spark, tmp_path):
    pages = [(i, f"<p>{t}</p>") for i, t in enumerate(ODD) if t is not None]
    got, want = against_sql(spark, tmp_path, "page_terms", pages=("page_id long, html string", pages))
    assert got == want


@pytest.mark.parametrize("chunk", [40, 16_000_000])
@pytest.mark.parametrize("name", ["tfidf", "bm25", "sparse_cosine"])
def test_vectors_by_chunks(spark, tmp_path, monkeypatch, name, chunk):
    monkeypatch.setattr(weights, "CHUNK", chunk)
    got, want = against_sql(spark, tmp_path, name, documents=odd_documents(3))
    assert got == want and got


def test_vectors_are_not_exchanged_by_term(spark):
    docs = spark.createDataFrame([(i, f"shared words w{i % 20} x{i % 7}") for i in range(40)], "doc_id long, text string")
    chunks = weights.chunked(docs)
    plan = kinds_of_plan(weights.vectors_of(chunks, weights.chunk_vocabulary(chunks, 40)))
    assert "Join" not in plan and plan.count("Window") == 1


def test_repeated_keys_are_one_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (1, "beta delta")], "doc_id long, text string")
    assert {tuple(r) for r in tokens.term_frequencies(docs).collect()} == {("alpha", 1, 1), ("beta", 3, 2), ("gamma", 1, 1), ("delta", 1, 1)}
    chunks = weights.chunked(docs)
    sizes = Counter(r["doc_id"] for r in weights.vectors_of(chunks, weights.chunk_vocabulary(chunks, 3, 1, 1.0)).collect())
    assert sizes == {1: 3, 2: 2}


def test_passes_of_the_latent_space_send_few_matrices(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(range(i % 5 * 6, i % 5 * 6 + 6)), [float(x) for x in 1 + rng.random(6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, dims array<int>, vals array<double>").repartition(40)
    sent = []
    whole = type(df).mapInArrow

    def noted(self, func, schema, *a, **b):
        sent.append(self.rdd.getNumPartitions()) if "sums" in schema else None
        return whole(self, func, schema, *a, **b)

    type(df).mapInArrow = noted
    try:
        got = {r["doc_id"]: np.array(r["vec"]) for r in vectors.latent_space_of(df, 30, 5).collect()}
    finally:
        type(df).mapInArrow = whole
    m = np.zeros((120, 30))
    for i, at, v in rows:
        m[i, at] = v
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = u[:, :5] * s[:5]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    cos = np.array([got[i] for i in range(120)])
    assert sent and max(sent) <= spark.sparkContext.defaultParallelism
    assert np.allclose(cos @ cos.T, want @ want.T, atol=1e-3)


def test_written_forms_are_those_of_all_words(spark):
    texts = ["Parsers parser parsers API", "parsers of APIs and API parsing", "API ParserKit parsed", None, ""]
    records = spark.createDataFrame(list(enumerate(texts)), "doc_id long, description string")
    surfaces, cased = written_forms(records)
    toks = tokens.tokenized(records, "description", ["doc_id"])
    want = naming.modal(toks.select("term", "surface"), "term", "surface").select("term", "surface")
    assert set(surfaces.collect()) == set(want.collect())
    want = naming.distinctive_casing(toks.select(F.lower("raw").alias("word"), F.col("raw").alias("written")))
    assert set(cased.collect()) == set(want.collect()) and cased.count()


def test_stems_are_remembered():
    udfs.stem_term.cache_clear()
    assert [udfs.stem_term(w) for w in ("parsers", "parsers", "kubernetes")] == ["parser", "parser", "kubernetes"]
    assert udfs.stem_term.cache_info().hits == 1
