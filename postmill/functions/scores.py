"""Coverage, scores, labels, intervals and vector distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage(met: Column, missing: Column) -> Column:
    """met / (met + missing); null where nothing was stated."""
    return F.try_divide(met.cast("double"), met + missing)


def score(met: Column, missing: Column, bars: Column) -> Column:
    """100 * coverage, halves to even; 0 with any bar; null where nothing was stated."""
    return F.when(bars > 0, F.lit(0)).otherwise(F.bround(coverage(met, missing) * 100).cast("int"))


def label(score: Column, threshold: int, delta: Column) -> Column:
    return F.when(score.isNull(), F.lit(None)).when(score >= threshold, "good_fit").when(F.coalesce(delta, F.lit(0)) >= 1, "reach").otherwise("fair")


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a share; nulls for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    mid = p + z * z / 2 / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    whole = 1 + F.lit(z * z) / n
    return F.when(n > 0, (mid - half) / whole), F.when(n > 0, (mid + half) / whole)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in doubles; null where a vector is zero or widths differ."""
    same = F.size(a) == F.size(b)
    return F.when(same, 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))
