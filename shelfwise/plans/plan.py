"""Plans: building, counting, checking, reading and writing."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line, rounded, stars
from ..operators.naming import MARKER, MAX_DESCRIPTION, MAX_NAME

VERSION = 1
REPO = "struct<full_name:string,description:string,similarity:double,stars:int,pushed_at:timestamp,starred_at:timestamp>"
SCHEMA = (
    "version int, generated_at timestamp, user string, backend string, settings map<string,string>, total_stars int, "
    f"categories array<struct<name:string,description:string,terms:array<string>,exists:boolean,cohesion:double,repos:array<{REPO}>>>, "
    f"unassigned array<{REPO}>"
)


def categories(members: DataFrame, labels: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (cluster, name, size, cohesion, exists, repos) of (cluster, full_name, similarity).

    Members, secondary ones too, come by similarity, then by name. `exists` compares names of
    lists in any case. Clusters without members have no row.
    """
    sim = rounded(F.col("similarity"))
    lists = existing.select(F.lower("name").alias("key")).distinct().withColumn("exists", F.lit(True))
    grouped = members.groupBy("cluster").agg(
        F.count("*").alias("size"),
        rounded(F.avg("similarity")).alias("cohesion"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.round("similarity", 9)).alias("order"), "full_name", sim.alias("similarity")))), lambda m: F.struct(m["full_name"].alias("full_name"), m["similarity"].alias("similarity"))).alias("repos"),
    )
    named = grouped.join(labels, "cluster").withColumn("key", F.lower("name")).join(lists, "key", "left")
    return named.withColumn("exists", F.coalesce("exists", F.lit(False))).drop("key")


def counts(placements: DataFrame) -> DataFrame:
    """One row (n_categories, n_placements, n_repos) of rows (category, full_name)."""
    return placements.agg(F.countDistinct("category").alias("n_categories"), F.count("*").alias("n_placements"), F.countDistinct("full_name").alias("n_repos"))


def bad_name(full_name: Column) -> Column:
    """Why a name is not owner/name, or null."""
    return (
        F.when(F.coalesce(F.trim(full_name), F.lit("")) == "", "no name")
        .when(~full_name.rlike("^[^/]+/.+$"), "not owner/name")
        .when(full_name.rlike("^[^/]+/.*/"), "more than one slash")
        .when(full_name.rlike(r"\s"), "whitespace")
    )


def violations(cats: DataFrame, placements: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Rows (rule, category, detail): all that is wrong with a plan, at once.

    cats(position, name, description), placements(position, full_name), unassigned(full_name).
    """
    name, text = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    key = F.lower(F.trim(name))
    label = F.when(key == "", F.concat(F.lit("#"), F.col("position").cast("string"))).otherwise(name)
    rows = cats.select(label.alias("category"), name.alias("n"), text.alias("d"), key.alias("key"), "position")

    def rule(df: DataFrame, rule_name: str, test: Column, detail: Column) -> DataFrame:
        return df.where(test).select(F.lit(rule_name).alias("rule"), "category", detail.cast("string").alias("detail"))

    first = rows.where("key <> ''").groupBy("key").agg(F.min("position").alias("first"))
    twice = rows.join(first, "key").where("position > first")
    members = placements.join(rows.select("position", "category"), "position").withColumn("why", bad_name(F.col("full_name")))
    repeated = members.where("why is null").groupBy("category", "position", F.lower("full_name").alias("repo")).agg(F.count("*").alias("n")).where("n > 1")
    loose = unassigned.select(F.lit("unassigned").alias("category"), "full_name", bad_name(F.col("full_name")).alias("why"))
    found = [
        rule(rows, "empty-name", F.col("key") == "", F.lit("")),
        rule(rows, "long-name", (F.col("key") != "") & (F.length("n") > MAX_NAME), F.length("n")),
        rule(twice, "same-name", F.lit(True), F.col("key")),
        rule(rows, "long-description", F.length("d") > MAX_DESCRIPTION, F.length("d")),
        rule(rows, "no-marker", ~F.contains("d", F.lit(MARKER)), F.lit("")),
        rule(members, "bad-repo", F.col("why").isNotNull(), F.concat_ws(": ", F.coalesce("full_name", F.lit("")), "why")),
        rule(repeated, "repeated-repo", F.lit(True), F.col("repo")),
        rule(loose, "bad-unassigned", F.col("why").isNotNull(), F.concat_ws(": ", F.coalesce("full_name", F.lit("")), "why")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def save(plan: dict, path: str) -> None:
    """Write one plan as a JSON document, stamped with version and time."""
    stamped = {"version": VERSION, "generated_at": datetime.now(timezone.utc).isoformat()} | plan
    with open(path, "w", encoding="utf-8") as f:
        json.dump(stamped, f, ensure_ascii=False, indent=2, default=str)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The plan as one nested row; another version is refused."""
    df = spark.read.schema(SCHEMA).json(path, multiLine=True)
    found = [r[0] for r in df.select("version").distinct().collect()]
    if found != [VERSION]:
        raise ValueError(f"plan version {found}, expected {VERSION}")
    return df


def placements_of(plan: DataFrame) -> DataFrame:
    """Rows (category, full_name, similarity, stars) of a loaded plan."""
    cats = plan.select(F.explode("categories").alias("c"))
    return cats.select(F.col("c.name").alias("category"), F.explode("c.repos").alias("r")).select("category", "r.full_name", "r.similarity", "r.stars")


def _cut(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows up to place `most` (all, if 0), and the next with `rest`, the number of the others."""
    if most <= 0:
        return rows.withColumn("rest", F.lit(0).cast("long"))
    few = rows.where(F.col("at") <= most + 1).join(sizes, "position")
    return few.withColumn("rest", F.when(F.col("at") > most, F.col("n") - most).otherwise(0))


def markdown(cats: DataFrame, members: DataFrame, unassigned: DataFrame, user: str, backend: str) -> DataFrame:
    """Rows (section, at, line), in that order the lines of a plan's index as Markdown.

    cats(position, name, description), members(position, at, full_name, stars, description; at
    from 1 in each category), unassigned(at, full_name, stars). Section 0 is the head, category
    p is section p + 1, what is unassigned comes after all categories. No row meets another
    but to be counted, so an index may be as long as its table.
    """
    said = F.col("description")
    text = F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit(" — "), one_line(said))).otherwise("")
    item = F.concat(F.lit("- "), "full_name", stars(F.coalesce("stars", F.lit(0))))
    rows = members.select((F.col("position") + 1).cast("long").alias("section"), F.col("at").cast("long").alias("at"), F.concat(item, text).alias("line"))
    sizes = members.groupBy("position").agg(F.count("*").alias("n"))
    heads = cats.join(sizes, "position", "left").select(
        (F.col("position") + 1).cast("long").alias("section"),
        F.lit(0).cast("long").alias("at"),
        F.concat(F.lit("## "), "name", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n\n"), F.coalesce("description", F.lit(""))).alias("line"),
    )
    last = F.lit(2**62)
    rest = unassigned.select(last.alias("section"), F.col("at").cast("long").alias("at"), item.alias("line"))
    n_rest = unassigned.agg(F.count("*").alias("n"))
    rest_head = n_rest.where("n > 0").select(last.alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("## Uncategorized (%d)", "n").alias("line"))
    total = members.select("full_name").union(unassigned.select("full_name")).agg(F.countDistinct("full_name").alias("n")).join(cats.agg(F.count("*").alias("k")), how="cross")
    top = total.select(F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("at"), F.format_string(f"# {_escaped(user)}: %d records in %d categories ({_escaped(backend)})", "n", "k").alias("line"))
    return top.unionByName(heads).unionByName(rows).unionByName(rest_head).unionByName(rest)


def _escaped(s: str) -> str:
    return s.replace("%", "%%")


def listing(cats: DataFrame, members: DataFrame, unassigned: DataFrame, verbose: bool = False, limit: int = 0) -> DataFrame:
    """Rows (section, at, line): a plan for the terminal, 5 members of each category and 10 of
    the unassigned unless `verbose`, the first `limit` categories if that is above 0.

    cats(position, name, terms, cohesion, exists), members(position, at, full_name,
    similarity), unassigned(at, full_name); positions and places start from 1.
    """
    sizes = members.groupBy("position").agg(F.count("*").alias("n"))
    shown = cats if limit <= 0 else cats.where(F.col("position") <= limit)
    state = F.when(F.col("exists"), "exists").otherwise("new")
    head = F.format_string("  %-34s %3d repos  cohesion %.2f  (%s)\n  %-34s %s", "name", F.coalesce("n", F.lit(0)), "cohesion", state, F.lit(""), F.array_join("terms", ", "))
    heads = shown.join(sizes, "position", "left").select(F.col("position").cast("long").alias("section"), F.lit(0).cast("long").alias("at"), head.alias("line"))
    more = F.concat(F.lit("      … and "), F.col("rest").cast("string"), F.lit(" more"))
    rows = _cut(members.join(shown.select("position"), "position"), sizes, 0 if verbose else 5)
    item = F.when(F.col("rest") > 0, more).otherwise(F.format_string("      %-44s %.2f", "full_name", "similarity"))
    rows = rows.select(F.col("position").cast("long").alias("section"), F.col("at").cast("long").alias("at"), item.alias("line"))
    last = F.lit(2**62)
    n = unassigned.agg(F.count("*").alias("n")).where("n > 0")
    loose = _cut(unassigned.withColumn("position", last), n.withColumn("position", last), 0 if verbose else 10)
    loose = loose.select(last.alias("section"), F.col("at").cast("long").alias("at"), F.when(F.col("rest") > 0, more).otherwise(F.concat(F.lit("      "), "full_name")).alias("line"))
    loose_head = n.select(last.alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("  %d stars fit no category well enough to place:", "n").alias("line"))
    out = heads.unionByName(rows).unionByName(loose_head).unionByName(loose)
    if limit > 0:
        hidden = cats.agg(F.count("*").alias("n")).where(F.col("n") > limit)
        out = out.unionByName(hidden.select(F.lit(2**61).alias("section"), F.lit(0).cast("long").alias("at"), F.format_string("  … and %d more categories", F.col("n") - limit).alias("line")))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in order as one text file: a plan's index is read by people."""
    lines.orderBy("section", "at").select("line").coalesce(1).write.mode("overwrite").text(path)
