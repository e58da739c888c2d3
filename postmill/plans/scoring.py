"""Scores and reasons (AGG-10..12, MTH-01, MTH-02, PRJ-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import has_phrase, token_bag
from ..session import table
from .base import query

_FACTS = "(SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS met, count(*) FILTER (WHERE l_returnflag = 'N') AS missing, count(*) FILTER (WHERE l_tax = 0.08 AND l_discount = 0.1) AS bars FROM lineitem GROUP BY 1)"
_SCORE = "CASE WHEN bars > 0 THEN 0 WHEN met + missing = 0 THEN NULL ELSE CAST(round_even(met / (met + missing) * 100, 0) AS BIGINT) END"
_LABEL = f"CASE WHEN {_SCORE} IS NULL THEN NULL WHEN {_SCORE} >= 60 THEN 'good_fit' WHEN k % 3 - 1 >= 1 THEN 'reach' ELSE 'fair' END"


def _facts(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_if(flag == "A").alias("met"), F.count_if(flag == "N").alias("missing"), F.count_if((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)).alias("bars"))


def _scored(spark, d):
    return _facts(spark, d).withColumn("score", S.score(F.col("met"), F.col("missing"), F.col("bars")).cast("bigint"))


@query(f"SELECT k, {_SCORE} AS score, CASE WHEN met + missing > 0 THEN round(met / (met + missing), 6) END AS coverage FROM {_FACTS}")
def coverage_score(spark, d):
    """AGG-10, MTH-01: null where nothing is stated, halves to even."""
    return _scored(spark, d).select("k", "score", F.round(S.coverage(F.col("met"), F.col("missing")), 6).alias("coverage"))


@query(f"SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM {_FACTS}) GROUP BY label")
def score_label(spark, d):
    """MTH-02."""
    return _scored(spark, d).groupBy(S.label(F.col("score"), 60, F.col("k") % 3 - 1).alias("label")).agg(F.count("*").alias("n"))


_BAG = "(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ')"
_WORDS = ["the", "of the", "idiot", "mit license", "que"]


@query(f"""SELECT doc_id, CAST(len(list_filter({_WORDS}, lambda s: contains(bag, ' ' || s || ' '))) AS BIGINT) AS matched, CAST(5 AS BIGINT) AS total, array_to_string(list_filter({_WORDS}, lambda s: NOT contains(bag, ' ' || s || ' ')), ',') AS missing FROM (SELECT doc_id, {_BAG} AS bag FROM documents)""")
def keyword_coverage(spark, d):
    """AGG-12, ARR-04: whole tokens, not substrings."""
    wanted = F.array(*(F.lit(w) for w in _WORDS))
    rows = table(spark, d, "documents").select("doc_id", token_bag(F.col("text")).alias("bag"))
    missing = F.filter(wanted, lambda s: ~has_phrase(F.col("bag"), s))
    return rows.select("doc_id", (F.size(wanted) - F.size(missing)).cast("bigint").alias("matched"), F.size(wanted).cast("bigint").alias("total"), F.array_join(missing, ",").alias("missing"))


@query(f"""SELECT k, '{{"met":' || met || ',"missing":' || missing || coalesce(',"score":' || {_SCORE}, '') || ',"threshold":60}}' AS reasons FROM {_FACTS}""")
def reasons_json(spark, d):
    """PRJ-07, PRJ-11."""
    return _scored(spark, d).select("k", F.to_json(F.struct("met", "missing", "score", F.lit(60).alias("threshold"))).alias("reasons"))


@query("SELECT conv_id, string_agg(role || ': ' || length(text), '; ' ORDER BY turn) AS reasons FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id")
def reasons_joined(spark, d):
    """STR-20, AGG-20: one reason per row, in order."""
    rows = table(spark, d, "conversations").where("turn % 2 = 1").select("conv_id", "turn", F.concat_ws(": ", "role", F.length("text").cast("string")).alias("r"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]), "; ").alias("reasons"))
