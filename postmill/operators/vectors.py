"""Vectors: missing ones, widths, and exact nearest rows with a cap per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import cosine_distance


def missing(candidates: DataFrame, vectors: DataFrame, key: str, model: str) -> DataFrame:
    return candidates.join(vectors.where(F.col("model") == model).select(key), key, "left_anti")


def wrong_width(vectors: DataFrame, col: str, width: int) -> DataFrame:
    return vectors.where(F.col(col).isNull() | (F.size(col) != width))


def nearest(vectors: DataFrame, query: DataFrame, vector: str, tie: str, k: int, group: str | None = None, cap: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to the one query vector, at most ``cap`` of a group. The query is one row."""
    scored = vectors.crossJoin(F.broadcast(query.select(F.col(vector).alias("__q")).limit(1)))
    scored = scored.withColumn("distance", cosine_distance(F.col(vector), F.col("__q"))).drop("__q", vector)
    if group and cap:
        rank = F.row_number().over(W.partitionBy(group).orderBy("distance", tie))
        scored = scored.withColumn("__n", rank).where(F.col("__n") <= cap).drop("__n")
    return scored.orderBy("distance", tie).limit(k)
