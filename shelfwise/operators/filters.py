"""Filters and their reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_glob


def with_drop_reason(records: DataFrame, min_stars: int = 0, starred_after: datetime | Column | None = None, exclude: list[str] = (), name: str = "drop_reason") -> DataFrame:
    """Add the first reason to drop a record, or null to keep it.

    Order: fork, archived, min-stars, starred-before, excluded. An unknown time never drops.
    """
    cutoff = F.lit(starred_after) if isinstance(starred_after, datetime) else starred_after
    reason = F.when(F.col("fork"), "fork").when(F.col("archived"), "archived").when(F.col("stars") < min_stars, "min-stars")
    if cutoff is not None:
        reason = reason.when(F.col("starred_at") < cutoff, "starred-before")
    if exclude:
        reason = reason.when(matches_glob(F.col("full_name"), list(exclude)), "excluded")
    return records.withColumn(name, reason)


def kept(records: DataFrame, **rules) -> DataFrame:
    return with_drop_reason(records, **rules).where("drop_reason is null").drop("drop_reason")


def skip_report(reasons: DataFrame) -> DataFrame:
    """Dropped records by reason, in the order of its name."""
    return reasons.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n_skipped")).orderBy("drop_reason")


def stale_report(records: DataFrame, cutoff: Column, show: int = 10) -> DataFrame:
    """The `show` records pushed longest before the cutoff; unknown times are never stale."""
    return records.where(F.col("pushed_at") < cutoff).orderBy("pushed_at", "id").limit(show)


def flat_names(only: list[str]) -> list[str]:
    """The distinct names of a flag that may be repeated and hold commas, in lower case."""
    return sorted({part.strip().lower() for value in only for part in value.split(",")} - {""})


def selected(categories: DataFrame, only: list[str]) -> DataFrame:
    """Categories named in `only` (any case), the largest first; all, as they come, when empty.

    Categories without a column `size` are not put in order.
    """
    names = flat_names(only)
    if not names:
        return categories
    found = categories.where(F.lower(F.trim("name")).isin(names))
    return found.orderBy(F.desc("size"), "name") if "size" in categories.columns else found
