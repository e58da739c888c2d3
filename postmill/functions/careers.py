"""Seniority, and roles in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lookups import band


def seniority(newest_title: Column, years: Column) -> Column:
    """The newest title's band, else one by years; null when neither says."""
    by_years = F.when(years < 2, "junior").when(years < 5, "mid").when(years < 9, "senior").when(years.isNotNull(), "staff")
    return F.coalesce(band(newest_title), by_years)


def years_worked(spans: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, years): overlapping spans of months count once; keys without a dated span have no row."""
    before = W.partitionBy(key).orderBy(lo, hi).rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col(hi) - F.greatest(F.col(lo), F.coalesce(F.max(hi).over(before), F.col(lo))))
    return spans.where(F.col(lo).isNotNull()).withColumn("__m", new).groupBy(key).agg(F.round(F.sum("__m") / 12, 1).alias("years"))


def newest_first(roles: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Rank of each role: open ones first, then by end or else start."""
    order = W.partitionBy(key).orderBy(end.isNull().desc(), F.coalesce(end, start).desc_nulls_last(), start.desc_nulls_last())
    return roles.withColumn("place", F.row_number().over(order))
