"""Names of categories: class TF-IDF, display forms, composed names and descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import DISPLAY, LANG_PREFIX, NOT_A_SUBJECT, TOPIC_PREFIX

MAX_NAME = 32
MAX_DESCRIPTION = 160
MARKER = "Grouped by shelfwise."
BIGRAM_BOOST = 1.35
TOPIC_BOOST = 1.6


def class_scores(terms: DataFrame, bigrams: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows (cluster, term, score, weight): share of the cluster times share of the term.

    Terms are (doc_id, term, weight, topic_weight), bigrams (doc_id, bigram, weight); only
    primary assignments (doc_id, cluster) count. Words that came from topics gain up to 60 %.
    """
    return shares(class_sums(weighed(terms, bigrams), assigned))


def weighed(terms: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Rows (doc_id, term, w, t): terms and boosted bigrams, in whole millionths: sums are exact and fast."""
    units = lambda x: F.round(x * 1e6).cast("long")
    both = terms.select("doc_id", "term", units(F.col("weight")).alias("w"), units(F.col("topic_weight")).alias("t"))
    return both.unionByName(bigrams.select("doc_id", F.col("bigram").alias("term"), units(F.col("weight") * BIGRAM_BOOST).alias("w"), F.lit(0).cast("long").alias("t")))


def class_sums(both: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows (cluster, term, w, t): weights of terms by cluster, from (doc_id, term, w, t)."""
    return both.join(assigned, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))


def shares(per: DataFrame) -> DataFrame:
    """Rows (cluster, term, score, weight) of the sums (cluster, term, w, t), weights in the unit of w.

    The totals test `t`, and both readers the keys: so both need the same rows and columns of
    `per`, which is then computed and exchanged once; dealt by term it stays where it is.
    """
    per = per.where("cluster is not null and term is not null")
    total = per.groupBy("cluster").agg(F.sum("w").cast("double").alias("in_cluster"), F.min("t").alias("low")).where("low >= 0").drop("low")
    everywhere = per.withColumn("of_term", F.sum("w").over(Window.partitionBy("term")).cast("double"))
    w, t = F.col("w").cast("double"), F.col("t").cast("double")
    bonus = 1 + (TOPIC_BOOST - 1) * F.least(F.lit(1.0), t / w)
    scored = everywhere.join(total, "cluster").where("in_cluster > 0 and of_term > 0 and w > 0")
    return scored.select("cluster", "term", (w / F.col("in_cluster") * (w / F.col("of_term")) * bonus).alias("score"), w.alias("weight"))


def top_terms(scores: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 12)), "term")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value, n): the most common value of each key, then the first by name.

    Input (key, value), or what is counted already: (key, value, n), each pair once.
    """
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return _counted(rows, key, value).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _counted(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.select(*cols, "n") if "n" in rows.columns else rows.groupBy(*cols).agg(F.count("*").alias("n"))


def distinctive_casing(written: DataFrame) -> DataFrame:
    """Rows (word, written, n): spellings of a strict majority (three at least) with a capital
    that is not the first letter. Input (word, written), or counted as for `modal`."""
    w = Window.partitionBy("word")
    best = _counted(written, "word", "written").withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "written"))).where("r = 1")
    return best.where((F.col("n") >= 3) & (2 * F.col("n") > F.col("total")) & F.expr("substring(written, 2)").rlike(r"\p{Lu}")).drop("total", "r")


def name_coverage(assigned: DataFrame, terms: DataFrame, leads: DataFrame) -> DataFrame:
    """Rows (cluster, coverage): share of members that have the lead term, as word or bigram."""
    has = terms.select("doc_id", "term").distinct()
    joined = assigned.join(leads, "cluster").join(has.withColumn("hit", F.lit(1)), (F.col("lead") == F.col("term")) & (assigned["doc_id"] == has["doc_id"]), "left")
    return joined.groupBy("cluster").agg((F.count("hit") / F.count("*")).alias("coverage"), F.count("*").alias("size"))


def label_overlaps(labels: DataFrame) -> DataFrame:
    """Rows (a, b, overlap) for a < b: Jaccard of the lower-cased display terms."""
    low = labels.select("cluster", F.array_distinct(F.transform("terms", F.lower)).alias("t"))
    a, b = low.select(F.col("cluster").alias("a"), F.col("t").alias("ta")), low.select(F.col("cluster").alias("b"), F.col("t").alias("tb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    both, either = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return pairs.select("a", "b", F.when(either > 0, both / either).otherwise(0.0).alias("overlap"))


def merge_pair(overlaps: DataFrame, threshold: float = 0.3) -> tuple[int, int] | None:
    """The pair to merge next: the most alike; of equal ones the last."""
    r = overlaps.where(F.col("overlap") >= threshold).orderBy(F.desc("overlap"), F.desc("a"), F.desc("b")).head()
    return (r["a"], r["b"]) if r else None


def display(term: str, cased: dict[str, str]) -> str:
    """How a term is written on a label."""
    if term in DISPLAY:
        return DISPLAY[term]
    for prefix in (LANG_PREFIX, TOPIC_PREFIX):
        if term.startswith(prefix):
            rest = term[len(prefix) :]
            return display(rest if prefix == LANG_PREFIX else rest.replace("-", " "), cased)
    if " " in term:
        return " ".join(display(w, cased) for w in term.split(" "))
    return cased.get(term) or term[:1].upper() + term[1:]


def subjectless(label: str) -> bool:
    return label.lower().replace(" ", "") in NOT_A_SUBJECT


def _cut(s: str, n: int) -> str:
    return s if len(s) <= n else s[:n].strip()


def compose(terms: Sequence[str], scores: Sequence[float], used: set[str]) -> str:
    """A name of at most MAX_NAME characters that is in no case in `used`.

    A phrase around the leading term is preferred; else up to three terms that share no
    word; at last a number tells equal names apart.
    """
    if not terms:
        return "Uncategorized"
    free = lambda s: s.lower() not in used
    lead = terms[0].lower()
    for t, s in list(zip(terms, scores, strict=True))[1:]:
        if " " in t and s >= 0.25 * scores[0] and lead in t.lower().split() and len(t.encode()) <= MAX_NAME:
            if free(t):
                return t
            break
    parts = [terms[0]]
    if " " not in terms[0]:
        for t, s in list(zip(terms, scores, strict=True))[1:]:
            if s < 0.45 * scores[0] or len(parts) == 3:
                break
            if set(t.lower().split()) & {w for p in parts for w in p.lower().split()}:
                continue
            if len(" & ".join([*parts, t]).encode()) > MAX_NAME:
                break
            parts.append(t)
            if free(" & ".join(parts)):
                break
    base = _cut(" & ".join(parts), MAX_NAME)
    name, i = base, 2
    while not free(name):
        name = f"{_cut(base, MAX_NAME - len(str(i)) - 1)} {i}"
        i += 1
    return name


def describe(terms: Sequence[str], scores: Sequence[float]) -> str:
    """One sentence about up to four leading terms, and the marker, in 160 characters."""
    good: list[str] = []
    for t, s in zip(terms, scores, strict=True):
        if s < 0.2 * scores[0] or len(good) == 4:
            break
        if t not in good:
            good.append(t)
    while good:
        subject = good[0] if len(good) == 1 else f"{', '.join(good[:-1])} and {good[-1]}"
        text = f"Records about {subject}. {MARKER}"
        if len(text.encode()) <= MAX_DESCRIPTION or len(good) == 1:
            return text if len(text) <= MAX_DESCRIPTION else _cut(text, MAX_DESCRIPTION - 1) + "…"
        good.pop()
    return MARKER


def closest(found: list[dict], threshold: float) -> tuple[int, int] | None:
    """The clusters of the two labels most alike by their terms; of equal pairs the last."""
    best = None
    low = [{t.lower() for t in x["terms"]} for x in found]
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            overlap = len(low[i] & low[j]) / len(low[i] | low[j]) if low[i] and low[j] else 0.0
            if overlap >= (threshold if best is None else best[0]):
                best = (overlap, found[i]["cluster"], found[j]["cluster"])
    return best[1:] if best else None


def merged(per: DataFrame, sizes: dict[int, int], surfaces: DataFrame, cased: DataFrame, threshold: float = 0.3) -> dict[int, int]:
    """New number of each cluster, when those with labels alike are one: by size, then old number.

    Labels change with each merge, so they are made anew, from the sums of the first clusters
    `per` (cluster, term, w, t), until no pair reaches the threshold. There are some dozens.
    """
    into = {c: c for c in sizes}
    while True:
        total: dict[int, int] = {}
        for c, to in into.items():
            total[to] = total.get(to, 0) + sizes[c]
        number = {c: i for i, c in enumerate(sorted(total, key=lambda c: (-total[c], c)))}
        now = {c: number[to] for c, to in into.items()}
        if threshold <= 0 or len(total) < 2:
            return now
        table = per.sparkSession.createDataFrame(list(now.items()), "cluster int, number int")
        joined = per.join(F.broadcast(table), "cluster").groupBy(F.col("number").alias("cluster"), "term").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
        pair = closest(labels(shares(joined), surfaces, cased), threshold)
        if pair is None:
            return now
        into = {c: pair[0] if n == pair[1] else n for c, n in now.items()}


def labels(scores: DataFrame, surfaces: DataFrame, cased: DataFrame, top: int = 6, spare: int = 40) -> list[dict]:
    """Named labels in the order of clusters: cluster, name, terms, scores, lead, description.

    Names depend on the ones before, so they are composed on the driver, from `spare` ranked
    terms of each cluster (there are at most some dozens of clusters); where so many are
    passed over that fewer than `top` remain though there were more, from four times as many.
    """
    found, cut = _labels(scores, surfaces, cased, top, spare)
    while cut:
        spare *= 4
        found, cut = _labels(scores, surfaces, cased, top, spare)
    return found


def _labels(scores: DataFrame, surfaces: DataFrame, cased: DataFrame, top: int, spare: int) -> tuple[list[dict], bool]:
    ranked = top_terms(scores, spare).select("cluster", "rank", "term", "score").collect()
    terms = sorted({r["term"] for r in ranked})
    shown = dict(surfaces.where(F.col("term").isin(terms)).select("term", "surface").collect())
    words = sorted({w for t in terms for w in (shown.get(t) or t).split(" ")})
    case = dict(cased.where(F.col("word").isin(words)).select("word", "written").collect())
    out, used, cut = [], set(), False
    groups: dict[int, list] = {}
    for r in sorted(ranked, key=lambda r: (r["cluster"], r["rank"])):
        groups.setdefault(r["cluster"], []).append(r)
    for c, rows in sorted(groups.items()):
        seen, terms, values, lead = set(), [], [], ""
        for r in rows:
            d = display(shown.get(r["term"]) or r["term"], case)
            if not d or subjectless(d) or d.lower() in seen:
                continue
            seen.add(d.lower())
            lead = lead or r["term"]
            terms.append(d)
            values.append(float(r["score"]))
            if len(terms) == top:
                break
        cut |= len(terms) < top and len(rows) == spare
        name = compose(terms, values, used)
        used.add(name.lower())
        out.append({"cluster": c, "name": name, "terms": terms, "scores": values, "lead": lead, "description": describe(terms, values)})
    return out, cut
