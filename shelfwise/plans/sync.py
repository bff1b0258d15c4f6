"""What must change for the remote lists to match a plan.

wanted: rows (category, full_name); lists: rows (list_id, name, description, count);
memberships: rows (list_id, full_name). Lists are matched by name in any case, members by
their exact name. A list whose description carries the marker is managed, others are left
alone unless adopted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import flat_names
from ..operators.naming import MARKER

MAX_LISTS = 32
BATCH = 25


@dataclass(frozen=True)
class Options:
    only: tuple[str, ...] = ()
    reconcile: bool = False
    force: bool = False
    adopt: bool = False
    limit: int = 0

    def check(self) -> None:
        if self.limit > 0 and (self.reconcile or self.force):
            raise ValueError("a limit cannot bound reconcile or force")
        if self.force and self.only:
            raise ValueError("force cannot be combined with a selection")


def managed(lists: DataFrame) -> DataFrame:
    return lists.withColumn("managed", F.contains(F.coalesce("description", F.lit("")), F.lit(MARKER)))


def _current(lists: DataFrame, memberships: DataFrame) -> DataFrame:
    keys = lists.select("list_id", F.lower("name").alias("key"))
    return memberships.join(keys, "list_id").select("key", "full_name").distinct()


def _wanted(wanted: DataFrame) -> DataFrame:
    return wanted.select(F.lower("category").alias("key"), "full_name").distinct()


def additions(wanted: DataFrame, lists: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (key, full_name) of the plan that are not yet in their list."""
    return _wanted(wanted).join(_current(lists, memberships), ["key", "full_name"], "left_anti")


def skipped(wanted: DataFrame, lists: DataFrame, memberships: DataFrame) -> DataFrame:
    return _wanted(wanted).join(_current(lists, memberships), ["key", "full_name"], "left_semi")


def stale(wanted: DataFrame, lists: DataFrame, memberships: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, full_name) of managed lists of the plan that the plan does not want there."""
    plan = _wanted(wanted)
    ours = managed(lists).where("managed")
    if only:
        ours = ours.where(F.lower("name").isin([o.lower() for o in only]))
    ours = ours.join(plan.select("key").distinct(), F.lower("name") == F.col("key"), "left_semi")
    return _current(ours, memberships).join(plan, ["key", "full_name"], "left_anti")


def desired_sets(wanted: DataFrame, lists: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (full_name, keys): the whole set of lists of each repo that changes, sorted."""
    add = additions(wanted, lists, memberships).groupBy("full_name").agg(F.collect_set("key").alias("add"))
    drop = stale(wanted, lists, memberships).groupBy("full_name").agg(F.collect_set("key").alias("drop"))
    have = _current(lists, memberships).groupBy("full_name").agg(F.collect_set("key").alias("have"))
    none = F.array().cast("array<string>")
    changed = add.join(drop, "full_name", "full").join(have, "full_name", "left")
    keep = F.array_except(F.coalesce("have", none), F.coalesce("drop", none))
    return changed.select("full_name", F.array_sort(F.array_union(keep, F.coalesce("add", none))).alias("keys"))


def dropped_lists(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """Managed lists the plan no longer has."""
    return managed(lists).where("managed").join(_wanted(wanted).select("key").distinct(), F.lower("name") == F.col("key"), "left_anti")


def list_budget(wanted: DataFrame, lists: DataFrame, most: int = MAX_LISTS) -> DataFrame:
    """One row (n_existing, n_new, fits): whether the lists of the plan have room."""
    new = _wanted(wanted).select("key").distinct().join(lists.select(F.lower("name").alias("key")), "key", "left_anti")
    return lists.agg(F.count("*").alias("n_existing")).join(new.agg(F.count("*").alias("n_new")), how="cross").withColumn("fits", F.col("n_existing") + F.col("n_new") <= most)


def freed_lists(wanted: DataFrame, lists: DataFrame, most: int = MAX_LISTS) -> DataFrame:
    """The fewest droppable lists, smallest first, whose deletion makes room (lists are few)."""
    room = list_budget(wanted, lists, most).select((F.col("n_existing") + F.col("n_new") - most).alias("excess"))
    ranked = dropped_lists(wanted, lists).withColumn("rank", F.row_number().over(Window.orderBy("count", "list_id")))
    return ranked.join(room, F.col("rank") <= F.col("excess")).drop("excess")


def missing(wanted: DataFrame, lists: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows (key, full_name, list_missing): what a check of the remote state does not find."""
    have = lists.select(F.lower("name").alias("key")).distinct().withColumn("there", F.lit(True))
    return additions(wanted, lists, memberships).join(have, "key", "left").select("key", "full_name", F.col("there").isNull().alias("list_missing"))


def conflicts(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """Lists with a planned name that are not managed: skipped unless adopted."""
    return managed(lists).where("not managed").join(_wanted(wanted).select("key").distinct(), F.lower("name") == F.col("key"), "left_semi")


def resettable(lists: DataFrame) -> DataFrame:
    return managed(lists).where("managed")


def taken_over(wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """Lists as they are once those with a planned name have been adopted: all of them managed."""
    keys = _wanted(wanted).select("key").distinct().withColumn("planned", F.lit(True))
    found = lists.join(keys, F.lower("name") == F.col("key"), "left")
    ours = F.concat_ws(" ", "description", F.lit(MARKER))
    marked = F.when(F.col("planned") & ~F.contains(F.coalesce("description", F.lit("")), F.lit(MARKER)), ours).otherwise(F.col("description"))
    return found.withColumn("description", marked).select(*lists.columns)


@dataclass(frozen=True)
class Run:
    """What an apply comes to: memberships (key, full_name) after it, its log (action, key,
    full_name), the lists (list_id, name) it deletes and the keys of those it creates, the
    keys it leaves alone as conflicts, and whether a limit cut it short."""

    memberships: DataFrame
    log: DataFrame
    deleted: DataFrame
    created: DataFrame
    conflicts: DataFrame
    stopped: DataFrame


def applied(wanted: DataFrame, lists: DataFrame, memberships: DataFrame, options: Options = Options(), most: int = MAX_LISTS) -> Run:
    """An apply of the categories selected, against the state as it has been read.

    Repos only leave lists when reconciling, which also deletes managed lists that the plan
    no longer has, unless the run is narrowed to some categories. If the lists that remain and
    those to be created exceed `most`, the run is refused, or, with force, deletes as few
    droppable lists as make room. A limit bounds the repos that are written: the first by name
    are, each with all its lists. Applied again, the log is empty.
    """
    options.check()
    only = flat_names(list(options.only))
    plan = wanted.where(F.lower(F.trim("category")).isin(only)) if only else wanted
    if plan.isEmpty():
        raise ValueError("no categories selected")
    if options.adopt:
        lists = taken_over(plan, lists)
        skip = conflicts(plan, lists).limit(0)
    else:
        skip = conflicts(plan, lists)
        plan = plan.join(skip.select(F.lower("name").alias("c")), F.lower("category") == F.col("c"), "left_anti")
    deleted, kept = dropped_lists(wanted, lists).limit(0), lists
    if options.reconcile and not only:
        deleted = dropped_lists(wanted, lists)
        kept = lists.join(deleted.select("list_id"), "list_id", "left_anti")
    room = list_budget(plan, kept, most).head()
    if not room["fits"]:
        if not options.force:
            raise ValueError(f"{most} lists are allowed; {room['n_existing']} exist and {room['n_new']} more are needed")
        excess = room["n_existing"] + room["n_new"] - most
        spare = dropped_lists(wanted, kept).orderBy("count", "list_id").limit(excess).select(*deleted.columns)
        if spare.count() < excess:
            raise ValueError(f"too few lists can be deleted to make room for {room['n_new']}")
        deleted = deleted.unionByName(spare)
        kept = kept.join(spare.select("list_id"), "list_id", "left_anti")
    log = additions(plan, kept, memberships).select(F.lit("add").alias("action"), "key", "full_name")
    if options.reconcile:
        gone = stale(wanted, kept, memberships, tuple(only))
        log = log.unionByName(gone.select(F.lit("remove").alias("action"), "key", "full_name"))
    stopped = log.sparkSession.range(1).select(F.lit(False).alias("stopped"))
    if options.limit > 0:
        repos = log.select("full_name").distinct()
        stopped = repos.agg((F.count("*") > options.limit).alias("stopped"))
        log = log.join(repos.orderBy("full_name").limit(options.limit), "full_name", "left_semi").select("action", "key", "full_name")
    now = _current(kept, memberships)
    after = now.join(log.where("action = 'remove'"), ["key", "full_name"], "left_anti").unionByName(log.where("action = 'add'").select("key", "full_name"))
    created = _wanted(plan).select("key").distinct().join(kept.select(F.lower("name").alias("key")), "key", "left_anti")
    return Run(after.distinct(), log, deleted.select("list_id", "name"), created, skip.select(F.lower("name").alias("key")), stopped)


def apply(wanted: DataFrame, lists: DataFrame, memberships: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(memberships after the run, action log (action, key, full_name)) of `applied`."""
    run = applied(wanted, lists, memberships, options)
    return run.memberships, run.log


def resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (full_name, repo_id) of distinct names, by the name that was asked for.

    known: rows (full_name, repo_id), the answers, under the names asked; a name that is not
    owner/name, or has no answer or an empty one, has a null id.
    """
    asked = names.select("full_name").distinct()
    good = known.where((F.col("repo_id") != "") & F.contains("full_name", F.lit("/"))).groupBy("full_name").agg(F.min("repo_id").alias("repo_id"))
    return asked.join(good, "full_name", "left")


def unresolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (full_name): renamed or deleted, these cannot be filed."""
    return resolved(names, known).where("repo_id is null").select("full_name")


class TooLarge(Exception):
    """A sink refuses a batch for the work it asks for, not for what it says."""


Sink = Callable[[list[tuple[str, str, list[str]]]], dict[str, str]]


def sent(batch: list[tuple[str, str, list[str]]], sink: Sink) -> dict[str, str]:
    """The failures by full_name of one batch, halved as often as the sink finds it too large."""
    try:
        return sink(batch)
    except TooLarge as e:
        if len(batch) == 1:
            return {batch[0][1]: str(e) or "too large"}
        at = len(batch) // 2
        return sent(batch[:at], sink) | sent(batch[at:], sink)


def written(run: Run, known: DataFrame, sink: Sink, batch: int = BATCH) -> DataFrame:
    """Rows (full_name, error: null if written) of writing each changed repo's whole set.

    The sink gets batches of (repo_id, full_name, keys) and returns errors by full_name. A
    write replaces the set, so a task that is run again changes nothing. Repos without an id
    are not sent and are reported; a failure of one repo or batch stops no other.
    """
    changed = run.log.select("full_name").distinct()
    held = run.memberships.join(changed, "full_name", "left_semi").groupBy("full_name").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    sets = resolved(changed, known).join(held, "full_name", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = list(zip(part["repo_id"], part["full_name"], part["keys"], strict=True))
            out = [(name, "unknown: renamed or deleted?") for repo, name, _ in rows if repo is None]
            rows = [(repo, name, list(keys)) for repo, name, keys in rows if repo is not None]
            for at in range(0, len(rows), batch):
                some = rows[at : at + batch]
                try:
                    failed = sent(some, sink)
                except Exception as e:  # the batch as a whole
                    failed = {name: str(e) for _, name, _ in some}
                out += [(name, failed.get(name)) for _, name, _ in some]
            yield pd.DataFrame(out, columns=["full_name", "error"])

    return sets.select("repo_id", "full_name", "keys").mapInPandas(send, "full_name string, error string")


def verified(wanted: DataFrame, lists: DataFrame, memberships: DataFrame, run: Run, only: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, full_name, list_missing) that a run asserts and the state read back lacks.

    A whole run asserts the selected categories less its conflicts; one stopped by its limit
    only what it has filed or found in place. full_name is null where a whole list is missing.
    """
    names = flat_names(list(only))
    want = _wanted(wanted.where(F.lower(F.trim("category")).isin(names)) if names else wanted)
    want = want.join(run.conflicts, "key", "left_anti")
    if run.stopped.head()[0]:
        want = want.join(run.memberships, ["key", "full_name"], "left_semi")
    have = lists.select(F.lower("name").alias("key")).distinct()
    no_list = want.select("key").distinct().join(have, "key", "left_anti")
    lost = want.join(have, "key", "left_semi").join(_current(lists, memberships), ["key", "full_name"], "left_anti")
    return lost.withColumn("list_missing", F.lit(False)).unionByName(no_list.select("key", F.lit(None).cast("string").alias("full_name"), F.lit(True).alias("list_missing")))
