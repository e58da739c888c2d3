"""Dates of sources, and months of employment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(value: Column) -> Column:
    """Digits are epoch milliseconds; otherwise an ISO time, in UTC where it has no offset; null for anything else."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.coalesce(F.timestamp_millis(F.when(text.rlike(r"^-?\d+$"), text).try_cast("bigint")), F.when(~text.rlike(r"^-?\d+$"), F.try_to_timestamp(text)))


def from_epoch_seconds(value: Column) -> Column:
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.coalesce(F.timestamp_seconds(F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text).try_cast("double")), F.when(~text.rlike(r"^-?\d+(\.\d+)?$"), to_utc(value)))


def rfc2822(value: Column) -> Column:
    """``Mon, 02 Jan 2006 15:04:05 +0000``; the weekday is not read."""
    text = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s(GMT|UTC|UT|Z)$", " +0000"), r"^(\d) ", "0$1 ")
    return F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss Z"))


def days_before(run: dt.datetime, days: int) -> Column:
    """A cutoff from the run's own time, the same on every row."""
    return F.lit(run - dt.timedelta(days=days))


def month_ordinal(value: Column, end: bool = False) -> Column:
    """Months since year 0: YYYY-MM, or YYYY, which begins in January and as an end reaches into the next."""
    year, month = F.regexp_extract(value, r"^(\d{4})(-(\d{2}))?$", 1), F.regexp_extract(value, r"^(\d{4})-(\d{2})$", 2)
    m = F.when(month != "", month.try_cast("int")).otherwise(F.lit(13 if end else 1))
    return F.when((year != "") & ((month == "") | m.between(1, 12)), year.try_cast("int") * 12 + m)


def span(start: Column, end: Column, today: Column) -> Column:
    """(lo, hi) in months; no start, no span; an open end is today; never negative."""
    lo = month_ordinal(start)
    hi = F.coalesce(month_ordinal(end, end=True), today)
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.greatest(lo, hi).alias("hi")))
