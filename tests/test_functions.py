from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.functions.porter2 import stem
from shelfwise.functions.readme import opening, skipped
from shelfwise.functions.timespec import parse_since
from shelfwise.operators import tokens

NOW = datetime(2026, 9, 7, 12, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("said", "meant"),
    [
        ("", None),
        ("2024-01-01", datetime(2024, 1, 1, tzinfo=timezone.utc)),
        ("2024-01-01T10:00:00Z", datetime(2024, 1, 1, 10, tzinfo=timezone.utc)),
        ("2y", datetime(2024, 9, 7, 12, tzinfo=timezone.utc)),
        ("18mo", datetime(2025, 3, 7, 12, tzinfo=timezone.utc)),
        ("30d", datetime(2026, 8, 8, 12, tzinfo=timezone.utc)),
        ("12h", datetime(2026, 9, 7, tzinfo=timezone.utc)),
        ("-90m", datetime(2026, 9, 7, 10, 30, tzinfo=timezone.utc)),
    ],
)
def test_parse_since(said, meant):
    assert parse_since(said, NOW) == meant


@pytest.mark.parametrize("said", ["last tuesday", "yesterday", "xy", "-2y"])
def test_parse_since_refuses(said):
    with pytest.raises(ValueError):
        parse_since(said, NOW)


def test_calendar_months_roll_over():
    assert parse_since("1mo", datetime(2026, 3, 31, tzinfo=timezone.utc)) == datetime(2026, 3, 3, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("word", "root"),
    [("parsers", "parser"), ("operator", "oper"), ("awesome", "awesom"), ("pipelines", "pipelin"), ("react", "react"), ("native", "nativ"), ("templates", "templat"), ("monitoring", "monitor"), ("exporters", "export"), ("analytics", "analyt"), ("query", "queri"), ("treesitter", "treesitt"), ("generously", "generous"), ("happiness", "happi"), ("skies", "sky"), ("sensational", "sensat")],
)
def test_stem(word, root):
    assert stem(word) == root


def terms(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    return [r["term"] for r in tokens.tokenized(df, "t", ["doc_id"]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("go-github", ["github"]),
        ("HTTPServerPool", ["http", "server", "pool"]),
        ("k8s_operator", ["kubernetes", "oper"]),
        ("the best awesome list of tools", ["awesom", "list"]),
        ("v1.2.3", []),
        ("k8s ci pipelines", ["kubernetes", "cicd", "pipelin"]),
        ("C++ library for .NET and Node.js; C# bindings and an F# port", ["cpp", "dotnet", "nodejs", "csharp", "bind", "fsharp", "port"]),
        ("a powerful modern tool to help you create and use projects", []),
        ("vim nvim neovim Neovim", ["vim"] * 4),
    ],
)
def test_terms(spark, text, expected):
    assert terms(spark, text) == expected


def test_signs_inside_words_stay(spark):
    assert "cpp" not in terms(spark, "libc++ headers")
    assert "dotnet" not in terms(spark, "asp.netcore host")


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("kube-prometheus", {"kubernetes", "prometheus", "kubeprometheus"}),
        ("go_router", {"router", "gorouter"}),
        ("TanStackQuery", {"tan", "stack", "queri", "tanstackquery"}),
        ("kubernetes", {"kubernetes"}),
        ("Type-Script", {"type", "script", "lang:typescript"}),
        ("node.js", {"nodejs"}),
        ("", set()),
    ],
)
def test_compound_names(spark, name, expected):
    df = spark.createDataFrame([(1, name)], "doc_id long, name string")
    parts = tokens.tokenized(df, "name", ["doc_id"])
    both = parts.select("term").union(tokens.compound_names(df, parts).select("term"))
    assert {r[0] for r in both.collect()} == expected


def test_topic_index_takes_the_most_used(spark):
    df = spark.createDataFrame([("kubernetes-cluster",)] * 3 + [("k8s-cluster",)] * 4 + [("one-two-three",)] * 5, "topic string")
    rows = tokens.topic_index(df, 3).collect()
    assert [(r["w0"], r["w1"], r["canonical"]) for r in rows] == [("kubernetes", "cluster", "k8s-cluster")]


def test_globs_and_names(spark):
    df = spark.createDataFrame([("torvalds/linux",), ("a/awesome-x",), ("plain",), ("a/b/c",)], "n string")
    got = [tuple(r) for r in df.select(X.owner(F.col("n")), X.name(F.col("n")), X.matches_glob(F.col("n"), ["torvalds/*", "awesome-*"])).collect()]
    assert got == [("torvalds", "linux", True), ("a", "awesome-x", True), ("", "plain", False), ("a", "b/c", False)]
    with pytest.raises(ValueError):
        X.glob_pattern("[a")


def test_rounding_truncates(spark):
    df = spark.createDataFrame([(-0.5,), (0.0005,), (1.2345,)], "x double")
    assert [r[0] for r in df.select(X.rounded(F.col("x"))).collect()] == [-0.499, 0.001, 1.235]


def test_cap_bytes():
    assert X.cap_bytes("one two three", 9) == "one two"
    assert X.cap_bytes("ééé", 3) == "é"
    assert X.cap_bytes("short", 0) == "short"


def test_opening_passes_over_badges_and_setup():
    prose = "This program reads tables of any size and joins them by keys that are only nearly equal to each other."
    md = f"# Nearly\n\n[![b](x)](y)\n\nJoins that forgive.\n\n## Installation\n\n{'install words ' * 10}\n\n## About\n\n{prose}\n\n```\ncode\n```\n"
    assert opening(md, 120) == f"Nearly Joins that forgive. {prose}"
    assert opening(md, 3) == "Nearly Joins that"
    assert skipped("Quick start guide") and not skipped("Supported platforms")
    assert opening("", 10) == ""


def test_setext_headings_and_tables():
    md = "Title\n=====\n\n| a | b |\n|---|---|\n\nWords here.\n\nUsage\n-----\n\nnever shown\n"
    assert opening(md) == "Title Words here."


def test_long_words_are_read_once(spark):
    import time

    texts = ["a" * 1_000_000, "x://" + "b" * 1_000_000, "[" * 100_000, "bB" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).cache()
    df.count()
    df.limit(1).select(tokens.words(F.col("text"))).collect()
    began = time.time()
    n = dict(df.select("doc_id", F.size(tokens.words(F.col("text")))).collect())
    assert time.time() - began < 5 and n == {0: 1, 1: 0, 2: 0, 3: 50_000 + 1}


def test_guarded_replacements(spark):
    cases = {
        "see http://a.example/b?c=(d) now": "see   now",
        "foo-http://a www.b.example end": "    end",
        "x:// ://y a://b": "x:// ://y  ",
        "[words](link) and ![gone](img) [kept]": " words  and   [kept]",
        "<b>bold</b> 1 < 2 > 0": " bold  1 < 2 > 0",
        "C++ c# F#, .NET Node.js c+++ .network": "cpp csharp fsharp, dotnet nodejs cpp+ .network",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["c"] for r in df.select("s", X.clean(F.col("s")).alias("c")).collect()} == cases
