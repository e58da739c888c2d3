"""Vectors (VEC, WIN-02, SRT-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import cosine_distance
from ..operators import vectors as V
from ..session import table
from .base import query

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_COS = "1 - " + _DOT.format("e.embedding", "q.embedding") + " / (sqrt(" + _DOT.format("e.embedding", "e.embedding") + ") * sqrt(" + _DOT.format("q.embedding", "q.embedding") + "))"


def _query(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding")


@query(f"SELECT e.vec_id, round({_COS}, 6) + 0.0 AS distance, round(1 - ({_COS}), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_distances(spark, d):
    """VEC-01, VEC-03, JN-09, MTH-04: every vector against the query vector."""
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(_query(spark, d).withColumnRenamed("embedding", "q")))
    dist = cosine_distance(F.col("embedding"), F.col("q"))
    return e.select("vec_id", (F.round(dist, 6) + 0.0).alias("distance"), F.round(1 - dist, 4).alias("similarity"))


@query(f"SELECT vec_id, label FROM (SELECT e.vec_id, e.label, {_COS} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY dist, vec_id LIMIT 40")
def knn_topk(spark, d):
    """SRT-01."""
    return V.nearest(table(spark, d, "embeddings"), _query(spark, d), "embedding", "vec_id", 40).select("vec_id", "label")


@query(f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rn FROM (SELECT e.vec_id, e.label, {_COS} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rn <= 5 ORDER BY dist, vec_id LIMIT 40")
def knn_cap_per_group(spark, d):
    """WIN-02: at most five per employer, then the nearest."""
    return V.nearest(table(spark, d, "embeddings"), _query(spark, d), "embedding", "vec_id", 40, "label", 5).select("vec_id", "label")


@query("SELECT label, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong, count(*) AS n FROM embeddings GROUP BY label")
def vector_width_check(spark, d):
    """VEC-02."""
    e = table(spark, d, "embeddings")
    wrong = V.wrong_width(e, "embedding", 64).groupBy("label").agg(F.count("*").alias("wrong"))
    return e.groupBy("label").agg(F.count("*").alias("n")).join(wrong, "label", "left").select("label", F.coalesce("wrong", F.lit(0)).alias("wrong"), "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def missing_vectors_anti(spark, d):
    """JN-05, JN-02, VEC-04, PRJ-09: candidates without a vector of the model."""
    model = F.when(F.col("label") % 2 == 0, "small@v1").otherwise("large@v1")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), model.alias("model"))
    return V.missing(table(spark, d, "documents").select("doc_id"), v, "doc_id", "small@v1")
