"""Points in time as people write them: dates, ages and durations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def _calendar(now: datetime, years: int = 0, months: int = 0) -> datetime:
    """Go back by calendar units; a day the month lacks rolls over into the next."""
    total = now.year * 12 + now.month - 1 - 12 * years - months
    first = now.replace(year=total // 12, month=total % 12 + 1, day=1)
    return first + timedelta(days=now.day - 1)


def parse_since(text: str, now: datetime) -> datetime | None:
    """The moment meant by a date, an RFC 3339 time, `18mo`, `2y`, `30d` or a duration.

    Empty means none. Counts may not be negative; durations count backwards either way.
    """
    if not text:
        return None
    for form in ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S%z"):
        try:
            at = datetime.strptime(text, form)
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    if m := re.fullmatch(r"(\d+)(mo|y|d)", text):
        n = int(m[1])
        return {"mo": lambda: _calendar(now, months=n), "y": lambda: _calendar(now, years=n), "d": lambda: now - timedelta(days=n)}[m[2]]()
    if re.fullmatch(r"[+-]?(?:\d+(?:\.\d*)?(?:ns|us|µs|ms|h|m|s))+", text):
        parts = re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|h|m|s)", text)
        return now - timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in parts))
    raise ValueError(f"not a date or an age: {text!r}")
