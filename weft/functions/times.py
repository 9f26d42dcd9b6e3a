"""Times as the tables hold them: ISO-8601 UTC text, beside parsed timestamps."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """Timestamp of an ISO text; null if it isn't one."""
    return F.try_to_timestamp(c)


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, null if a side can't be parsed or the end comes first."""
    ms = F.unix_millis(parsed(end)) - F.unix_millis(parsed(start))
    return F.when(ms >= 0, ms)


def clock_millis(c: Column) -> Column:
    """Milliseconds since 1970 of a time without a zone, read as UTC whatever the session's zone is."""
    parts = [f(c) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    return F.unix_millis(F.make_timestamp_ltz(*parts, F.extract(F.lit("SECOND"), c), F.lit("UTC")))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_of_epoch(c: Column) -> Column:
    return iso(F.timestamp_seconds(c))


def local_day(c: Column) -> Column:
    """Day of an ISO time in the session's time zone."""
    return F.to_date(parsed(c))


def bound(text: str, now: dt.datetime | None = None) -> str:
    """A time bound: ``<N>d`` before now, or a UTC time, as ISO text."""
    if m := re.fullmatch(r"(\d+)d", text.strip()):
        at = (now or dt.datetime.now(dt.timezone.utc)) - dt.timedelta(days=int(m[1]))
        return at.strftime("%Y-%m-%dT%H:%M:%SZ")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", text.strip()):
        raise ValueError("a bound is <N>d or a UTC time such as 2024-01-31T00:00:00Z")
    return text.strip()


def between(c: Column, since: str | None, until: str | None, as_text: bool = False) -> Column:
    """since <= c < until, by time, or by text where the tables are compared so."""
    value = (lambda x: x) if as_text else parsed
    out = F.lit(True)
    if since is not None:
        out = out & (value(c) >= value(F.lit(since)))
    if until is not None:
        out = out & (value(c) < value(F.lit(until)))
    return out
