import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import cluster as C
from shelfwise.operators import naming, refine, tokens, vectors
from shelfwise.plans import plan, sync
from shelfwise.plans.pipeline import extend_plan
from shelfwise.sources import snapshots


def space_of(spark, vecs, clusters=None):
    rows = [(i, None if clusters is None else clusters[i], [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "row_id long, cluster int, vec array<double>")


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    d = np.maximum(0, 2 * (1 - x @ x.T))

    def cost(a, b):
        n, m = len(a), len(b)
        s = lambda p, q: sum(d[i, j] for i in p for j in q)
        return 2 * n * m / (n + m) * (s(a, b) / (n * m) - s(a, a) / (2 * n * n) - s(b, b) / (2 * m * m))

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(3))
def test_ward_equals_brute_force(seed):
    x = np.random.default_rng(seed).standard_normal((40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    merges = C.ward_tree(x)
    for k in (3, 5, 8):
        label = C.cut_tree(merges, len(x), k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in range(k)} == brute_ward(x, k)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_ward_on_tiny_inputs(n):
    x = np.eye(3)[:n]
    label = C.cut_tree(C.ward_tree(x), n, 6)
    assert sorted(label.tolist()) == list(range(n))


def test_cuts_nest():
    a = np.arange(40) * 0.157
    merges = C.ward_tree(np.stack([np.cos(a), np.sin(a)], axis=1))
    four, five = C.cut_tree(merges, 40, 4), C.cut_tree(merges, 40, 5)
    assert all(len(set(four[five == c])) == 1 for c in range(5))


def test_kmeans_recovers_arcs(spark):
    a = np.concatenate([np.full(4, t) + 0.002 * np.arange(4) for t in (0, 2.1, 4.2)])
    placed, _ = C.kmeans(space_of(spark, np.stack([np.cos(a), np.sin(a)], axis=1)).drop("cluster"), 3)
    label = {r["row_id"]: r["cluster"] for r in placed.collect()}
    assert len({frozenset(i for i in label if label[i] == c) for c in label.values()} & {frozenset(range(s, s + 4)) for s in (0, 4, 8)}) == 3


def test_latent_space_equals_exact_svd(spark):
    rng = np.random.default_rng(3)
    m = (rng.random((14, 9)) < 0.4) * rng.random((14, 9)) + np.eye(14, 9)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cells = [(i, f"t{j}", float(m[i, j])) for i in range(14) for j in range(9) if m[i, j]]
    v = spark.createDataFrame(cells, "doc_id long, term string, val double")
    got = {r["doc_id"]: np.array(r["vec"]) for r in vectors.latent_space(v, v.select("term").distinct(), dims=3).collect()}
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    want = u[:, :3] * s[:3]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    cos = np.array([got[i] for i in range(14)])
    assert np.allclose(cos @ cos.T, want @ want.T, atol=1e-4)


def test_latent_space_clamps(spark):
    v = spark.createDataFrame([(i, f"t{j}", 1.0) for i in range(3) for j in range(i + 1)], "doc_id long, term string, val double")
    assert all(len(r["vec"]) <= 3 for r in vectors.latent_space(v, v.select("term").distinct(), dims=500).collect())


def test_weights_never_negative_and_monotone(spark):
    tf = [0.01, 0.15, 0.3, 1 / np.e, 0.5, 0.9, 1.0, 1.2, 3.0, 18.0]
    terms = spark.createDataFrame([(i, "x", t) for i, t in enumerate(tf)] + [(i, "y", 1.0) for i in range(10)], "doc_id long, term string, weight double")
    vocab = terms.select("term").distinct().withColumn("df", F.lit(1)).withColumn("idf", F.lit(1.0))
    raw = {r["doc_id"]: r["val"] for r in vectors.tfidf(terms, vocab).where("term = 'x'").collect()}
    vals = [raw[i] for i in range(10)]
    assert min(vals) >= 0 and vals == sorted(vals)


def test_vocabulary_cap_keeps_what_repeats(spark):
    rows = [(i, f"unique{i}") for i in range(12)] + [(i, "shared") for i in range(6)] + [(i, "pairwise") for i in range(2)]
    t = spark.createDataFrame(rows, "doc_id long, term string")
    kept = {r["term"] for r in vectors.vocabulary(t, 12, min_df=1, max_df_ratio=0.5, cap=2).collect()}
    assert "shared" in kept


def test_zero_weight_emits_nothing(spark):
    r = spark.createDataFrame([(1, "own", "alpha beta", "gamma delta", [])], "doc_id long, owner string, name string, description string, topics array<string>")
    t, b = tokens.weighted_terms(r, tokens.Weights(owner=0, name=0))
    assert {x["term"] for x in t.collect()} == {"gamma", "delta"} and {x["bigram"] for x in b.collect()} == {"gamma delta"}


def test_silhouette_skips_singletons(spark):
    got = C.silhouette(space_of(spark, np.eye(3), [0, 0, 1])).head()
    assert got["n"] == 2 and C.silhouette(space_of(spark, np.eye(2), [0, 0])).head()["score"] is None


@pytest.mark.parametrize("med", [0.9, 0.36, 0.01, -0.1, -0.9])
def test_floor_is_below_the_median(spark, med):
    sims = spark.createDataFrame([(i, 0, med + d) for i, d in enumerate((-0.01, 0.0, 0.0, 0.01, 0.02))], "row_id long, cluster int, sim double")
    f = refine.fit_floors(sims, min_sim=-2.0).head()
    assert f["floor"] <= f["med"] - 0.4 * abs(f["med"]) + 1e-12


def test_incremental_placement_moves_nothing(spark):
    a = [0, 0.05, 3.1, 3.15, 0.02, 1.5]
    s = space_of(spark, np.stack([np.cos(a), np.sin(a)], axis=1)).drop("cluster")
    decided = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "row_id long, cluster int")
    got = {r["row_id"]: r["cluster"] for r in extend_plan(s, decided).collect()}
    assert got.get(4) == 0 and set(got) <= {4, 5}


def test_names():
    assert naming.compose(["Actions", "GitHub", "GitHub Actions", "Runner"], [1, 0.9, 0.8, 0.4], set()) == "GitHub Actions"
    assert naming.compose(["Actions", "GitHub", "GitHub Actions", "Runner"], [1, 0.9, 0.1, 0.05], set()) == "Actions & GitHub"
    assert naming.compose([], [], set()) == "Uncategorized"
    assert naming.compose(["Vim"], [1.0], {"vim"}) == "Vim 2"
    assert naming.display("topic:machine-learning", {}) == "Machine Learning"
    assert naming.display("mcp", {"mcp": "MCP"}) == "MCP"
    assert naming.describe(["A", "B", "C"], [1, 0.5, 0.1]) == f"Records about A and B. {naming.MARKER}"
    assert naming.subjectless("Good First Issue")


def test_merge_pair_takes_the_last_of_equals(spark):
    o = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.2)], "a int, b int, overlap double")
    assert naming.merge_pair(o) == (0, 2) and naming.merge_pair(o, 0.6) is None


def state(spark):
    mark = f"x {naming.MARKER}"
    wanted = spark.createDataFrame([("Kubernetes", "a/helm"), ("Kubernetes", "b/k3s"), ("Rust", "c/tokio")], "category string, full_name string")
    lists = spark.createDataFrame([("1", "kubernetes", mark, 1), ("2", "Old", mark, 3), ("3", "Mine", "by hand", 2)], "list_id string, name string, description string, count long")
    mem = spark.createDataFrame([("1", "a/helm"), ("1", "z/stale"), ("3", "b/k3s")], "list_id string, full_name string")
    return wanted, lists, mem


def test_sync(spark):
    wanted, lists, mem = state(spark)
    assert {tuple(r) for r in sync.apply(wanted, lists, mem)[1].collect()} == {("add", "kubernetes", "b/k3s"), ("add", "rust", "c/tokio")}
    after, log = sync.apply(wanted, lists, mem, sync.Options(reconcile=True))
    assert {tuple(r) for r in log.collect()} == {("add", "kubernetes", "b/k3s"), ("add", "rust", "c/tokio"), ("remove", "kubernetes", "z/stale")}
    assert {r["full_name"]: r["keys"] for r in sync.desired_sets(wanted, lists, mem).collect()} == {"b/k3s": ["kubernetes", "mine"], "c/tokio": ["rust"], "z/stale": []}
    assert [r["name"] for r in sync.dropped_lists(wanted, lists).collect()] == ["Old"]
    assert sync.list_budget(wanted, lists, 3).head()["fits"] is False
    assert [r["name"] for r in sync.freed_lists(wanted, lists, 3).collect()] == ["Old"]
    ids = {"kubernetes": "1", "mine": "3", "rust": "4", "old": "2"}
    lists2 = lists.union(spark.createDataFrame([("4", "Rust", naming.MARKER, 0)], lists.schema))
    mem2 = spark.createDataFrame([(ids[r["key"]], r["full_name"]) for r in after.collect()], "list_id string, full_name string")
    assert sync.apply(wanted, lists2, mem2)[1].count() == 0
    assert sync.missing(wanted, lists2, mem2).count() == 0


def test_sync_options(spark):
    with pytest.raises(ValueError):
        sync.Options(limit=1, reconcile=True).check()
    with pytest.raises(ValueError):
        sync.Options(force=True, only=("a",)).check()
    assert sync.apply(*state(spark), sync.Options(limit=1))[1].count() == 1
    with pytest.raises(ValueError):
        sync.apply(*state(spark), sync.Options(only=("Nothing",)))
    with pytest.raises(ValueError):
        sync.applied(*state(spark), most=3)
    run = sync.applied(*state(spark), sync.Options(force=True), most=3)
    assert [r["name"] for r in run.deleted.collect()] == ["Old"] and [r["key"] for r in run.created.collect()] == ["rust"]
    run = sync.applied(*state(spark), sync.Options(reconcile=True, only=("rust",)))
    assert run.deleted.count() == 0 and {tuple(r) for r in run.log.collect()} == {("add", "rust", "c/tokio")}


def test_adopting_and_conflicts(spark):
    wanted, lists, mem = state(spark)
    wanted = wanted.union(spark.createDataFrame([("mine", "q/r")], wanted.schema))
    run = sync.applied(wanted, lists, mem)
    assert [r["key"] for r in run.conflicts.collect()] == ["mine"]
    assert ("add", "mine", "q/r") not in {tuple(r) for r in run.log.collect()}
    assert all(r["key"] != "mine" for r in sync.verified(wanted, lists, mem, run).collect())
    run = sync.applied(wanted, lists, mem, sync.Options(adopt=True, reconcile=True))
    assert {("add", "mine", "q/r"), ("remove", "mine", "b/k3s")} <= {tuple(r) for r in run.log.collect()}


def test_batches_are_halved_and_failures_kept_apart():
    calls = []

    def sink(batch):
        calls.append(len(batch))
        if len(batch) > 2 or batch[0][1] == "x2":
            raise sync.TooLarge("much")
        return {"x1": "gone"} if any(name == "x1" for _, name, _ in batch) else {}

    rows = [(str(i), f"x{i}", ["a"]) for i in range(5)]
    assert sync.sent(rows, sink) == {"x1": "gone", "x2": "much"}
    assert calls == [5, 2, 3, 1, 2]


def test_verification_reports_missing_lists_once(spark):
    wanted, lists, mem = state(spark)
    got = {tuple(r) for r in sync.verified(wanted, lists, mem, sync.applied(wanted, lists, mem)).collect()}
    assert got == {("kubernetes", "b/k3s", False), ("rust", None, True)}


def test_snapshots_load(spark, tmp_path):
    from datetime import datetime, timedelta

    path, now, day = str(tmp_path / "snap"), datetime(2024, 3, 1), timedelta(days=1)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), "text") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, starred_at timestamp, readme string")
    bare = df.drop("readme")
    reads = []

    def load(at, ttl=86400, full=10 * 86400, tail=bare, everything=df, **more):
        def read_all():
            reads.append("all")
            return everything

        return snapshots.load_records(spark, path, "me", at, read_all, lambda cached: tail, ttl, full, **more)

    first, how = load(now)
    assert how == "full" and first.columns == ["id", "starred_at"] and first.count() == 120
    assert load(now + day / 2)[1] == "cached"
    grown = bare.union(spark.createDataFrame([(500, datetime(2024, 2, 1))], bare.schema))
    records, how = load(now + 2 * day, tail=grown.where("id >= 20"))
    assert how == "topped up" and records.count() == 121 and reads == ["all"]
    assert load(now + 4 * day, tail=grown.where("id >= 22"))[1] == "full"  # the pages do not meet
    assert load(now + 15 * day, tail=grown.where("id >= 20"))[1] == "full"  # too long since all were read
    assert load(now + 15 * day, refresh=True)[1] == "full"
    assert snapshots.read_snapshot(spark, path, "you", now) is None
    assert snapshots.read_snapshot(spark, str(tmp_path / "none"), "me", now) is None
    (tmp_path / "bad" / "version=1").mkdir(parents=True)
    (tmp_path / "bad" / "version=1" / "part-0.parquet").write_bytes(b"not a table")
    assert snapshots.read_snapshot(spark, str(tmp_path / "bad"), "me", now) is None


def test_fatal_failures_stop_a_worker(spark):
    def fetch(name):
        if name == "b":
            raise snapshots.Fatal
        return name * 2

    names = spark.createDataFrame([("a",), ("b",), ("c",)], "full_name string")
    got = [tuple(r) for r in snapshots.fetched_texts(names, fetch, 1).collect()]
    after = [name for name, *_ in got[[r[0] for r in got].index("b") :]]
    assert {r for r in got if r[0] in after} == {(n, None, "unread") for n in after}
    assert {r for r in got if r[0] not in after} == {(n, n * 2, "fetched") for n in "abc" if n not in after}


def test_extended_plan_keeps_what_was_decided(spark):
    from shelfwise.plans.pipeline import Settings, extended

    rng = np.random.default_rng(3)
    base = np.eye(3)[[0] * 6 + [1] * 6 + [2] * 2 + [0, 1]] + rng.normal(0, 0.1, (16, 3))
    base[15] = [0.7, 0.7, 0.0]
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    rows = space_of(spark, unit, [0] * 16).drop("cluster")
    listed = [(i, 0) for i in range(6)] + [(i, 1) for i in range(6, 12)] + [(0, 1), (99, 0)]
    prev = spark.createDataFrame([(0, "By Hand", "edited", ["t"], "t"), (1, "Two", "d", ["u"], "u")], "cluster int, name string, description string, terms array<string>, lead string")
    left = spark.createDataFrame([(12,)], "row_id long")
    plan = extended(rows, spark.createDataFrame(listed, "row_id long, cluster int"), left, prev, Settings(multi_list=2), {"dims": "9"}, "2024-01-01")
    got = plan.members.collect()
    sums = {c: unit[[i for i, k in listed if k == c and i < 16]].sum(axis=0) for c in (0, 1)}
    centre = {c: v / np.linalg.norm(v) for c, v in sums.items()}
    for r in got:
        assert abs(r["sim"] - unit[r["row_id"]] @ centre[r["cluster"]]) < 1e-6
    held = {(r["row_id"], r["cluster"]): r["rank"] for r in got}
    assert all(held[i, c] == (1 if (i, c) == (0, 1) else 0) for i, c in listed if i < 16)
    assert (12, 0) not in held and (12, 1) not in held and (14, 0) in held
    assert {c for i, c in held if i == 15} == {0, 1}  # as near to both, so a second list
    assert 12 in {r["row_id"] for r in plan.unassigned.collect()}
    cats = {r["name"]: r["description"] for r in plan.categories.collect()}
    assert cats == {"By Hand": "edited", "Two": "d"}
    assert plan.settings["dims"] == "9" and plan.settings["incremental-from"] == "2024-01-01"


def test_plan_round_trip(spark, tmp_path):
    repo = {"full_name": "a/b", "description": "d", "similarity": 0.5, "stars": 3}
    plan.save({"user": "u", "categories": [{"name": "N", "description": "d", "terms": [], "exists": False, "cohesion": 0.5, "repos": [repo]}], "unassigned": []}, str(tmp_path / "p.json"))
    assert [tuple(r) for r in plan.placements_of(plan.load(spark, str(tmp_path / "p.json"))).collect()] == [("N", "a/b", 0.5, 3)]
    (tmp_path / "q.json").write_text('{"version": 2}')
    with pytest.raises(ValueError):
        plan.load(spark, str(tmp_path / "q.json"))


def test_topped_up_needs_the_same_page(spark):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, at string").select("id", F.col("at").cast("timestamp").alias("starred_at"))
    cached = df.where("id < 8")
    merged, ok = snapshots.topped_up(cached, df.where("id >= 5"), page=3)
    assert ok and merged.count() == 12
    assert not snapshots.topped_up(cached, df.where("id >= 6"), page=3)[1]
    assert not snapshots.topped_up(df.where("id < 2"), df, page=3)[1]


def test_stream_places_each_row_once(spark, tmp_path):
    from shelfwise.streaming.placement import place_stream

    a = [0, 0.05, 3.1, 3.15]
    members = space_of(spark, np.stack([np.cos(a), np.sin(a)], axis=1), [0, 0, 1, 1])
    centres = C.centroids(members)
    floors = refine.fit_floors(C.similarities(members, centres))
    members.select("row_id", "vec").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, vec array<double>").parquet(str(tmp_path / "in"))
    for _ in range(2):
        place_stream(stream, centres, floors, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("row_id", "cluster").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_plan_merges_names_and_covers(spark):
    from shelfwise.plans.pipeline import Settings, make_plan

    kinds = [
        ("orchard pruning apple trees", "pears and plums in winter frost"),
        ("harbour pilot tug boats", "tide tables of northern quays"),
        ("violin strings bow rosin", "luthier varnish and old spruce"),
    ]
    rows = [(i, f"o{i % 5}", f"r{i}", f"{kinds[i % 3][0]} {kinds[i % 3][1].split()[i % 5]} {kinds[i % 3][1].split()[(i + 2) % 5]}", []) for i in range(48)]
    rows += [(100 + i, "o9", f"x{i}", " ".join(f"odd{(i * 7 + j * 13) % 41}word" for j in range(6)), []) for i in range(3)]
    records = spark.createDataFrame(rows, "doc_id long, owner string, name string, description string, topics array<string>")
    plan = make_plan(records, Settings(clusters=6, dims=8, multi_list=2))
    cats = {r["cluster"]: r for r in plan.categories.collect()}
    members = plan.members.collect()
    first = {r["row_id"]: r["cluster"] for r in members if r["rank"] == 0}
    assert sorted(cats) == list(range(len(cats))) and len(cats) >= 3
    sizes = [cats[c]["size"] for c in sorted(cats)]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(first)
    low = [{t.lower() for t in cats[c]["terms"]} for c in sorted(cats)]
    assert all(len(a & b) < 0.3 * len(a | b) for i, a in enumerate(low) for b in low[i + 1 :])
    for c in cats:  # no category holds two kinds
        assert len({i % 3 for i, own in first.items() if own == c and i < 100}) <= 1
    left = {r["row_id"] for r in plan.unassigned.collect()}
    assert left | set(first) == {r[0] for r in rows} and not left & set(first)
    assert len({cats[c]["name"].lower() for c in cats}) == len(cats) and plan.settings["merge_overlap"] == "0.3"


def test_labels_look_further_when_terms_are_passed_over(spark):
    scores = spark.createDataFrame([(0, f"w{i:03d}", 1.0 / (i + 1), 1.0) for i in range(60)], "cluster int, term string, score double, weight double")
    shown = spark.createDataFrame([(f"w{i:03d}", "todo" if i < 50 else f"word{i}") for i in range(60)], "term string, surface string")
    none = spark.createDataFrame([], "word string, written string")
    assert naming.labels(scores, shown, none)[0]["terms"] == [f"Word{i}" for i in range(50, 56)]


def test_merged_labels_take_the_last_of_equal_pairs():
    found = [{"cluster": c, "terms": t} for c, t in enumerate((["a", "b"], ["A", "b"], ["c"], ["B", "a"]))]
    assert naming.closest(found, 0.3) == (1, 3) and naming.closest(found[1:3], 0.3) is None


def test_kmeans_search_and_consensus(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:6]
    x = np.repeat(centres, 12, axis=0) + 0.05 * rng.standard_normal((72, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").cache()
    want = {frozenset(range(12 * c, 12 * c + 12)) for c in range(6)}

    def groups(rows):
        out = {}
        for r in rows.collect():
            out.setdefault(r["cluster"], set()).add(r["row_id"])
        return {frozenset(g) for g in out.values()}

    assert C.search_k(space, 5, 8) == 6
    assert groups(C.kmeans_best(space, 6)) == want
    found, middle, score = C.consensus(space, 6)
    assert groups(found) == want and score > 0.9
    by_hand = {tuple(np.round(x[sorted(g)].sum(0) / np.linalg.norm(x[sorted(g)].sum(0)), 6)) for g in want}
    assert {tuple(np.round(r["vec"], 6)) for r in middle.collect()} == by_hand


def test_ward_over_weighted_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(5)[:4], 20, axis=0) + 0.03 * rng.standard_normal((80, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<double>").cache()
    monkeypatch.setattr(C, "WARD_ROWS", 12)
    out = {r["row_id"]: r["cluster"] for r in C.ward(space, 4).collect()}
    assert len(out) == 80 and len({(out[i], i // 20) for i in out}) == 4
