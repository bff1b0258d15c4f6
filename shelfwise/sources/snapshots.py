"""Cached snapshots of records: expiry, joins, updates and sound top-ups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = 100
_STAMPS = ("user", "fetched_at", "full_fetched_at")


def unexpired(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries younger than the time to live; ttl <= 0 keeps all."""
    return entries if ttl_seconds <= 0 else entries.where(F.col("fetched_at") >= now - F.expr(f"interval {ttl_seconds} seconds"))


def deduplicated(records: DataFrame) -> DataFrame:
    """The first record of each id by its position."""
    w = Window.partitionBy("id").orderBy("position")
    return records.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def with_cached_text(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join of cached texts by full_name; records without one keep null."""
    return records.join(cache.select("full_name", F.col("text").alias("readme")), "full_name", "left")


def harvested(cache: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache after the update, rows that were new or changed); empty texts are no news."""
    news = fetched.where("text <> ''").join(cache.select("full_name", "text"), ["full_name", "text"], "left_anti")
    return cache.join(news.select("full_name"), "full_name", "left_anti").unionByName(news), news


def latest(entries: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The latest entry of each key."""
    return entries.groupBy(key).agg(F.max(at).alias(at), *[F.max_by(v, at).alias(v) for v in values])


def topped_up(cached: DataFrame, tail: DataFrame, page: int = PAGE) -> tuple[DataFrame, bool]:
    """(cached records and what follows them, whether the top-up is sound).

    `tail` is the source from the cached table's last page on. Both are ordered by
    (starred_at, id); the last `page` cached records must be, one by one, the first of the
    tail. A cache of less than a page is never topped up. Only two pages are ranked.
    """
    order = [F.col("starred_at"), F.col("id")]
    last = cached.orderBy(*[c.desc() for c in order]).limit(page).select("id", "starred_at")
    first = tail.orderBy(*order).limit(page).select("id", "starred_at")
    w = Window.orderBy("starred_at", "id")
    a = last.select(F.col("id").alias("a"), F.row_number().over(w).alias("at"))
    b = first.select(F.col("id").alias("b"), F.row_number().over(w).alias("at"))
    r = a.join(b, "at", "full").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same")).head()
    sound = r["n"] == page and r["same"] == page
    merged = cached.unionByName(tail.join(cached.select("id"), "id", "left_anti")) if sound else cached
    return merged, sound


@dataclass(frozen=True)
class Snapshot:
    """A table as it was read: when last, and when last from its first page to its last."""

    records: DataFrame
    fetched_at: datetime
    full_fetched_at: datetime


def read_snapshot(spark: SparkSession, path: str, user: str, now: datetime, ttl_seconds: int = 0) -> Snapshot | None:
    """The last snapshot at `path`, if it is this user's and not older than a ttl above 0.

    A path that is missing, empty, or holds no readable snapshot is a miss, never an error.
    """
    try:
        versions = spark.read.parquet(path)
        if not {"version", *_STAMPS} <= set(versions.columns):
            return None
        last = versions.agg(F.max("version")).head()[0]  # a partition column: no data is read
        if last is None:
            return None
        found = versions.where(F.col("version") == last)
        stamp = found.select(*_STAMPS).head()
    except (PySparkException, Py4JJavaError):
        return None
    if stamp is None or stamp["user"] != user or (ttl_seconds > 0 and now - stamp["fetched_at"] > timedelta(seconds=ttl_seconds)):
        return None
    return Snapshot(found.drop("version", *_STAMPS), stamp["fetched_at"], stamp["full_fetched_at"] or stamp["fetched_at"])


def write_snapshot(records: DataFrame, path: str, user: str, now: datetime, full_fetched_at: datetime | None = None) -> None:
    """A further version of a snapshot, without texts: those have a cache of their own.

    Versions are partitions that appear whole when their job ends, so a snapshot can be written
    from the one before it, and a job that dies leaves that one in force.
    """
    stamped = records.drop("readme").withColumns(
        {
            "user": F.lit(user),
            "fetched_at": F.lit(now).cast("timestamp"),
            "full_fetched_at": F.lit(full_fetched_at or now).cast("timestamp"),
            "version": F.lit(int(now.timestamp() * 1_000_000)),
        }
    )
    stamped.write.mode("append").partitionBy("version").parquet(path)


def load_records(
    spark: SparkSession,
    path: str,
    user: str,
    now: datetime,
    read_all: Callable[[], DataFrame],
    read_tail: Callable[[DataFrame], DataFrame],
    ttl_seconds: int,
    full_ttl_seconds: int,
    refresh: bool = False,
) -> tuple[DataFrame, str]:
    """(records, how they came): cached, topped up, or read in full.

    A snapshot within its time to live is used as it is. An older one is topped up from its
    last page on, unless its last *full* reading is older than `full_ttl_seconds` (if above 0;
    topping up does not renew that time) or the pages do not meet.
    """
    if not refresh:
        held = read_snapshot(spark, path, user, now, ttl_seconds)
        if held is not None and not held.records.isEmpty():
            return held.records, "cached"
        held = read_snapshot(spark, path, user, now)
        whole = held is not None and (full_ttl_seconds <= 0 or now - held.full_fetched_at <= timedelta(seconds=full_ttl_seconds))
        if whole and not held.records.isEmpty():
            merged, sound = topped_up(held.records, read_tail(held.records))
            if sound:
                write_snapshot(merged, path, user, now, held.full_fetched_at)
                return read_snapshot(spark, path, user, now).records, "topped up"
    write_snapshot(read_all(), path, user, now)
    return read_snapshot(spark, path, user, now).records, "full"


def embedded_texts(records: DataFrame) -> DataFrame:
    """Rows (full_name, text) of records of an older kind that still carry their texts."""
    return records.where(F.col("readme") != "").select("full_name", F.col("readme").alias("text"))


class Unavailable(Exception):
    """A text that will not become readable later: too large, blocked, taken down."""


class Fatal(Exception):
    """A failure that every further request would share: a bad token, a spent budget."""


def fetched_texts(names: DataFrame, fetch: Callable[[str], str], workers: int) -> DataFrame:
    """Rows (full_name, text, outcome) of fetching the text of each name, `workers` at a time.

    fetched: the text, a space where there is none, so that it is not asked for again.
    unavailable: a space likewise. failed: null, the next run tries again. unread: null,
    what a worker had left after a fatal failure. What was fetched stays whatever else fails;
    a lost executor's part is fetched again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            out = []
            for name in batch["full_name"]:
                text, outcome = None, "unread"
                if not stopped:
                    try:
                        text, outcome = fetch(name) or " ", "fetched"
                    except Unavailable:
                        text, outcome = " ", "unavailable"
                    except Fatal:
                        stopped = True
                    except Exception:  # a timeout, a reset: anything that may pass
                        outcome = "failed"
                out.append((name, text, outcome))
            yield pd.DataFrame(out, columns=["full_name", "text", "outcome"])

    return names.select("full_name").repartition(workers).mapInPandas(run, "full_name string, text string, outcome string")
