"""Time parsing and formatting."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of times that count.
PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")


def parse_seconds(text: Column) -> Column:
    """UTC seconds of whole seconds (negative: 0), RFC 3339, ``yyyy-MM-dd HH:mm:ss`` with dashes or slashes, or a date
    alone (midnight); 0 for anything else."""
    text = F.trim(text)
    tries = [F.when(text.rlike(r"^-?\d+$"), F.greatest(text.try_cast("long"), F.lit(0)))]
    for shape, p in zip((r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d$", r"^\d{4}/\d\d/\d\d$"), PATTERNS, strict=True):
        tries.append(F.when(text.rlike(shape), F.unix_seconds(F.try_to_timestamp(text, F.lit(p)))))
    return F.coalesce(*tries, F.lit(0)).cast("long")


def seconds_of(text: str) -> int | None:
    """The same on the driver, for a window's bounds; None for anything else."""
    text = text.strip()
    if text.lstrip("-").isdigit():
        return max(0, int(text))
    for p in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d"):
        try:
            got = datetime.strptime(text, p)
        except ValueError:
            continue
        return int((got if got.tzinfo else got.replace(tzinfo=timezone.utc)).timestamp())
    return None


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_to_utc(date: Column, time: Column, zone: str = "Asia/Shanghai") -> Column:
    """UTC timestamp of a local date and time; null where they cannot be read."""
    both = F.concat_ws(" ", date, time)
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(both, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(both, F.lit("yyyy/MM/dd HH:mm:ss"))), zone)
