"""Odd rows, odd column names and brute force for the training-data operators and stages."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
import corpus_pipeline
from shelfwise.llm import fingerprints, jaccard_join, language_id, mixing, packing, quality, secrets, sharding, suffix_dedup, token_counts
from shelfwise.llm.queries import tokenizer_file
from shelfwise.llm.tables import Scratch, named, scratch_root, stash

ODD = ["text_", "__text", "a.b", "x``y", "_text", "digest", "WHOLE", "spans_", "fold", "key_a", "copies", "n", "total", "mark", "part", "size", "__whole", "at"]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, null and empty texts, and columns with names that operators might use."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(90)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = [(i, t, "aa", "s1", len(t)) for i, t in enumerate(texts)]
    rows += [rows[0]] * 7 + [(None, texts[1], "aa", None, 3)] * 4 + [(None, None, None, None, None)] * 3 + [(50, "", "aa", "s2", 0), (51, None, None, "s2", None)]
    rows += [(52, "Token: abcdef123456 " + texts[2], "aa", "s1", 9)]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in fields] + [T.StructField(c, T.IntegerType()) for c in ODD])
    return spark.createDataFrame([(*r, *range(len(ODD))) for r in rows], schema).repartition(3).cache()


def test_operators_with_odd_names_and_rows(odd):
    n = odd.count()
    path, piece = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    model = language_id.fit(odd, F.lit(True))
    whole = {
        "op1": jaccard_join.jaccard_components(odd, counting=True),
        "op2": sharding.shard_rows(odd, 3),
        "op3": token_counts.with_token_counts(odd, piece),
        "op5": quality.with_stats(odd),
        "op6": suffix_dedup.without_repeats(odd),
        "op7": secrets.scan(odd),
        "op8": fingerprints.edited_fingerprints(odd),
        "op9": language_id.identified(odd, model),
        "op10": mixing.mix(mixing.document_sizes(odd)),
    }
    for name, df in whole.items():
        rows = df.collect()
        assert len(rows) == n, name
        ids = Counter(r["doc_id"] for r in rows)
        assert ids[None] == 7 and ids[0] == 8, name
        if name in ("op3", "op5", "op6", "op7", "op9"):
            carried = [c for c in ODD if c in df.columns]
            assert {"__text", "a.b", "x``y"} <= set(carried) and all(r[c] == ODD.index(c) for r in rows for c in carried), name
    for name in ("op3", "op5", "op6", "op7", "op9"):  # repeated rows get one answer
        own = [c for c in whole[name].columns if c not in ODD]
        assert whole[name].where("doc_id = 0").select(*own).distinct().count() == 1, name
    pieces = packing.packed(odd, path).collect()
    assert sum(r["piece"] == 0 for r in pieces) == n
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)


def test_stages_with_odd_names_and_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    at = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == i for r in rows for i, c in enumerate(ODD)), name
        at = out if name != "mixing_sources" else at
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeated_rows_share_copies(odd):
    rows = mixing.mix(mixing.document_sizes(odd)).collect()
    for key in (0, None):
        taken = [r["copies"] for r in rows if r["doc_id"] == key and r["size"]]
        assert max(taken) - min(taken) <= 1
    again = mixing.mix(mixing.document_sizes(odd.repartition(5))).collect()
    count = lambda x: Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in x)
    assert count(rows) == count(again)
    mixed = Counter(r["doc_id"] for r in mixing.mixed(odd).collect())
    assert sum(mixed.values()) == sum(r["copies"] for r in rows) and mixed[0] == sum(r["copies"] for r in rows if r["doc_id"] == 0)


def spans_by_hand(t):
    """Base spans by scanning characters, without regular expressions."""
    token, found = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), []
    low, at = t.lower(), 0
    while at < len(t):
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(w, at) and t[at : at + len(w)].isascii():
                p = at + len(w)
                p += p < len(t) and t[p] in "\"'"
                while p < len(t) and t[p] == " ":
                    p += 1
                if p < len(t) and t[p] in ":=":
                    p += 1
                    while p < len(t) and t[p] == " ":
                        p += 1
                    p += p < len(t) and t[p] in "\"'"
                    z = p
                    while z < len(t) and t[z] in token:
                        z += 1
                    if z > p:
                        if z - p >= 6:
                            found.append((at, z, "assign"))
                        at = z - 1
                        break
        at += 1
    for kind, first, more, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(t):
            z = at + len(first)
            if t.startswith(first, at):
                while z < len(t) and t[z] in more:
                    z += 1
            if z > at + len(first) and t.startswith(first, at):
                if z - at >= least:
                    found.append((at, z, kind))
                at = z
            else:
                at += 1
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_by_hand(spark):
    rng = random.Random(2)
    bits = ["password", "Api_Key", "APIKEY", "secret", "token", "passwd", ":", "=", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "0123456789abcdef01234567", "deadbeef", "XYZ123", "hunter2x", "é", "漢", "\n", "aB.c/d+e-f_g", "q", "ſecret", "toKen", "0" * 30, "Z" * 18]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    base = secrets.joined_spans("secret_spans", ("assign", "access", "hex"))
    for r in secrets.scan(df, carry=["doc_id"]).withColumn("base", base).collect():
        want = ",".join(f"{k}:{a}:{z}" for a, z, k in spans_by_hand(texts[r["doc_id"]] or ""))
        assert r["base"] == want, texts[r["doc_id"]]


def entropies_by_hand(t):
    base = [(a, z) for a, z, _ in spans_by_hand(t)]
    covered = [any(a <= i < z for a, z in base) for i in range(len(t))]
    run = [c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" for c in t]
    at, out = 0, []
    while at < len(t):
        if not run[at]:
            at += 1
            continue
        z = at
        while z < len(t) and run[z]:
            z += 1
        if z - at >= 20:
            a = at
            while a < z:
                e = a
                while e < z and not covered[e]:
                    e += 1
                s = t[a:e]
                if len(s) >= 20 and any(c.isalpha() for c in s):
                    digit, low, up = any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)
                    hexes = set(s) <= set("0123456789abcdef") or set(s) <= set("0123456789ABCDEF")
                    limit = (3.0 if hexes else 3.6) if digit else 3.87 if low and up else 99
                    peak = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
                    if peak >= limit - 1e-12 and not any(re.search(p, s) for p in secrets.ALLOWED):
                        out.append((a, e))
                a = e + 1
        at = z
    return out


def test_entropy_spans_by_hand():
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pools = ["0123456789ABCDEF", letters, letters + "0123456789", letters.lower(), "ab1", letters + "0123456789+/="]
    found = Counter()
    for _ in range(800):
        parts = ["".join(rng.choice(rng.choice(pools[:3])) for _ in range(rng.randint(5, 60))) if rng.random() < 0.3 else "".join(rng.choice(pool) for _ in range(rng.randint(5, 60))) for pool in rng.choices(pools, k=4)]
        t = rng.choice([" ", "-", "", " token=abcdef123 "]).join(parts)
        got = [(a, z) for a, z, k, _ in secrets.scan_text(t) if k == "entropy"]
        assert got == entropies_by_hand(t), t
        found[bool(got)] += 1
    assert min(found.values()) > 5
    hits = sum(any(k == "entropy" for _, _, k, _ in secrets.scan_text("".join(rng.choice(letters) for _ in range(40)))) for _ in range(200))
    assert hits > 180


def test_nearest_centroid_by_hand(spark):
    rng = random.Random(6)
    forms = {"aa": ["sha", "lo", "ti", "ren"], "bb": ["zü", "kro", "ich", "ung"], "cc": ["qua", "lo", "mi", "ren"]}
    rows = [(i, lang, " ".join("".join(rng.choice(forms[lang]) for _ in range(3)) for _ in range(rng.randint(1, 30)))) for i, lang in enumerate(["aa", "bb", "cc"] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    model = language_id.fit(df, F.lit(True))

    def counts(t):
        b = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", t.encode()).lower()
        out = np.zeros(language_id.DIMS)
        for k in (1, 2, 3):
            for p in range(len(b) - k + 1):
                if b[p] == 32 and b[p + k - 1] == 32:
                    continue
                out[((int.from_bytes(b[p : p + k], "big") + k) * 2654435761 % 2**32) >> 20] += 1
        return out

    seen = sum((counts(t) > 0).astype(int) for _, _, t in rows)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    assert np.allclose(model.idf, idf, atol=1e-4)
    for r in language_id.identified(df, model).collect():
        v = np.log1p(counts(rows[r["doc_id"]][2])) * idf
        cos = model.centroids @ (v / np.linalg.norm(v))
        assert abs(cos.max() - r["score"]) < 1e-4 and r["rejected"] == bool(cos.max() < model.floors[int(np.argmax(cos))])
        assert cos[[lang == r["lang_pred"] for lang in model.langs]].max() > cos.max() - 1e-5


def test_sample_is_the_same_in_any_order(spark):
    rows = [(i, "ab"[i % 2] * 2, f"w{i % 300} v{i % 7} some words here {i % 300}") for i in range(3000)]
    df = spark.createDataFrame([*rows, *[(None, "aa", "one text again and again")] * 2000], "doc_id long, lang string, text string")
    a, b = language_id.fit(df.repartition(2), F.lit(True), sample=100), language_id.fit(df.repartition(7), F.lit(True), sample=100)
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids, atol=1e-5) and np.allclose(a.floors, b.floors, atol=1e-5)


def test_labelled_sample_is_the_least_by_hash(spark):
    texts = [f"word {'x ' * (i % 9)} & {i}" for i in range(600)]
    stats = stash(quality.with_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 1800, 3)], "doc_id long, quality int")
    order = {r["id"]: r["h"] for r in spark.range(600).select("id", F.pmod(F.xxhash64("id"), F.lit(quality.SPACE_OF_HASHES)).alias("h")).collect()}
    want = sorted((i for i in range(0, 600, 3)), key=lambda i: (order[i], i))[:40]
    x, bad, _ = quality.labelled_sample(stats, labels, 40)
    assert len(bad) == 40 and bad.tolist() == [i % 2 == 0 for i in want]
    assert quality.labelled_sample(stats, labels, 10_000)[1].size == 200


def test_quality_verdict_follows_the_rules(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["plain", "words", "of", "some", "kind", "beta"]) + str(rng.randint(0, 99)) for _ in range(80)) + (" #" * 60 if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)], "doc_id long, quality int")
    out, rules = quality.judged(docs, labels)
    assert rules
    for r in out.collect():
        env = {s: r[s] for s in quality.STATS} | {"greatest": max}
        value = {f: eval(e.replace("cast(n_words as double)", "float(n_words)"), {}, env) for f, e in quality.FEATURES.items()}  # noqa: S307
        fires = any(all(value[f] <= t if op == "<=" else value[f] >= t for f, op, t in rule) for rule in rules)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and not fires)


def test_bins_are_plain_one_permutation_minhash(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (1, 3, 5, 6, 40, 300, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    grams = [(i, w[j : j + 5] if len(w) >= 5 else w) for i, w in ((i, t.split(" ")) for i, t in enumerate(texts)) for j in range(max(1, len(w) - 4))]
    hashed = spark.createDataFrame(grams, "doc_id int, g array<string>").withColumn("w", F.transform("g", lambda x: F.xxhash64(x)))
    hashed = hashed.withColumn("h", F.when(F.size("g") == 5, F.xxhash64(*[F.col("w")[j] for j in range(5)])).otherwise(F.xxhash64("w")))
    sets = {}
    for r in hashed.collect():
        sets.setdefault(r["doc_id"], set()).add(r["h"])
    probe = {(r["b"], r["x"]): r["h"] for r in spark.range(128).select(F.col("id").alias("b")).crossJoin(spark.range(128).select(F.col("id").alias("x"))).withColumn("h", F.xxhash64("b", "x")).collect()}
    for r in fingerprints.fingerprints(df).collect():
        least = {}
        for h in sets[r["doc_id"]]:
            b = (h % 2**64) >> 57
            least[b] = min(least.get(b, h), h)
        want = [least.get(b, least[min(least, key=lambda x: probe[b, x])]) & 255 for b in range(128)]
        assert [v & 255 for v in r["fingerprint_bins"]] == want, r["doc_id"]


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op2_sharding", "op3_token_counts", "op4_best_fit_packing", "op5_quality_rules", "op6_suffix_dedup", "op7_secret_scans", "op8_document_fingerprints", "op9_language_id", "op10_mixing_sources"])
def test_registered_queries(spark, name):
    rows = __spark_entry__.queries()[name](spark, SMALL).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    texts = dict(con.execute("select doc_id, text from documents").fetchall())
    assert {r["doc_id"] for r in rows} == set(texts) and (name.startswith("op4") or len(rows) == len(texts))
    if sql := __spark_entry__.oracle_sql().get(name):
        got = con.execute(sql)
        cols = [d[0] for d in got.description]
        assert Counter(got.fetchall()) == Counter(tuple(r[c] for c in cols) for r in rows)
    if name.startswith("op7"):
        for r in rows:
            want = spans_by_hand(texts[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in want).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k in want) for kind in ("assign", "access", "hex"))


def test_very_long_texts():
    unit = "lorem ipsum dolor sit amet consectetur " * 2
    text = "".join(f"{unit}{i} " for i in range(60_000)) + "z" * 1_000_000
    column = pa.array([text, "short one", None])
    path = tokenizer_file("byte_bpe_50k.json")
    from shelfwise.llm import byte_bpe, words

    sizes = [at for _, _, _, at in byte_bpe.encode(column, path)]
    assert sum(int(at[-1]) for at in sizes) > 600_000
    sets = list(words.text_shingles(column, 5))
    assert sum(len(s) for _, _, s, _ in sets) > 100_000
    stats = [s for _, _, s in quality.text_stats(column)]
    assert sum(int(s["n_words"].sum()) for s in stats) == len(text.split()) + 2
    pos, _ = suffix_dedup.anchors(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(text.encode()), 200)
    assert len(pos) > 50_000 and np.diff(pos).max() <= 137
    assert sum(len(c) for c in language_id._sliced(column)) > 0
    assert token_counts.Counter({"a": -1.0, "b": -2.0, "▁": -3.0}).text("ab" * 500_000) == 1_000_001


def test_long_strings_do_not_collide():
    from shelfwise.llm.words import Prefix

    a = "".join("ab"[bin(i).count("1") & 1] for i in range(4096)).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    h = Prefix(np.frombuffer(a + b, np.uint8)).of(np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]


def test_scratch_is_freed(spark):
    from pathlib import Path

    root = Path(scratch_root(spark))
    before = set(root.glob("stash-*"))
    with Scratch() as own:
        one, two = stash(spark.range(3)), stash(spark.range(4))
        with Scratch() as inner:
            kept, gone = stash(spark.range(5)), stash(spark.range(6))
            inner.keep(kept)
        assert kept.count() == 5 and not Path(gone._stash_path).exists()
        own.keep(two)
    left = set(root.glob("stash-*")) - before
    assert [p.name for p in left] == [Path(two._stash_path).name] and two.count() == 4 and one is not None


def test_names_are_taken_as_they_are(spark):
    df = spark.createDataFrame([(1, 2)], T.StructType([T.StructField("a.b", T.LongType()), T.StructField("x`y", T.LongType())]))
    assert df.select(named("a.b"), named("x`y")).head().asDict() == {"a.b": 1, "x`y": 2}
