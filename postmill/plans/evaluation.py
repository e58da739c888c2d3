"""Evaluation: sweeps, intervals, draws (AGG-13..19, SRT-06, SRT-07, WIN-05, WIN-07..09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import careers as C
from ..functions.dates import month_ordinal, span
from ..functions.scores import wilson
from ..operators import evaluation as E
from ..session import table
from .base import POSTINGS_SQL, postings, query

_SWEEP = """(SELECT t AS threshold, count(*) FILTER (WHERE score >= t AND relevant) AS hits, count(*) FILTER (WHERE score >= t) AS kept, count(*) FILTER (WHERE relevant) AS relevant
FROM (SELECT doc_id * 37 % 101 AS score, quality = 1 AND toxic = 0 AS relevant FROM labels), (SELECT unnest(range(0, 101, 5)) AS t) GROUP BY t)"""


def _judged(spark, d):
    return table(spark, d, "labels").select((F.col("doc_id") * 37 % 101).alias("score"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("relevant"))


@query(f"SELECT threshold, hits, kept, CASE WHEN kept > 0 THEN round(hits / kept, 6) END AS precision, round(hits / relevant, 6) AS recall FROM {_SWEEP}")
def threshold_sweep(spark, d):
    """AGG-14: counts per score once, then sums over thresholds; rows are not multiplied."""
    s = E.sweep(_judged(spark, d), "score", "relevant")
    return s.select("threshold", "hits", "kept", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT min(threshold) AS threshold FROM {_SWEEP} WHERE hits / kept >= 0.7 AND hits / relevant >= 0.2 AND kept >= 10")
def chosen_threshold(spark, d):
    """AGG-15."""
    return E.choose(E.sweep(_judged(spark, d), "score", "relevant"), 0.7, 0.2, 10)


_Z = "1.959963984540054"


@query(f"SELECT lang, round((p + z * z / 2 / n - z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n), 6) AS lo, round((p + z * z / 2 / n + z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n), 6) AS hi FROM (SELECT lang, CAST({_Z} AS DOUBLE) AS z, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE toxic = 1) / count(*) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def wilson_interval(spark, d):
    """AGG-16."""
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return j.select("lang", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT run, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM (SELECT 1 AS run, * FROM labels UNION ALL SELECT 2, * FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 0, * FROM labels UNION ALL SELECT 0, * FROM labels WHERE doc_id % 2 = 0) GROUP BY run")
def pooled_runs(spark, d):
    """AGG-17: runs and their pool, number 0."""
    x = table(spark, d, "labels")
    runs = x.withColumn("run", F.lit(1)).unionByName(x.where("doc_id % 2 = 0").withColumn("run", F.lit(2)))
    return E.with_pool(runs, "run").groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))


@query("SELECT source, round(count(*) FILTER (WHERE toxic = 0) / count(*), 6) AS precision, round(3 / count(*), 6) AS bound FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source")
def hard_negative_precision(spark, d):
    """AGG-18, AGG-19: shares of kept rows, and the rule of three."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 1"), "doc_id")
    return j.groupBy("source").agg(F.round(F.count_if(F.col("toxic") == 0) / F.count("*"), 6).alias("precision"), F.round(3 / F.count("*"), 6).alias("bound"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('7:pool:' || doc_id), doc_id) AS BIGINT) AS place FROM documents QUALIFY place <= 100")
def seeded_shuffle(spark, d):
    """SRT-07: the first hundred of a shuffle that a seed fixes."""
    return E.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 7, "pool", 100).select("doc_id", "place")


@query("SELECT source, rn, doc_id FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS BIGINT) AS rn, count(*) OVER (PARTITION BY source) AS size FROM documents) ORDER BY rn, size, source LIMIT 60")
def stratified_round_robin(spark, d):
    """WIN-07: one of each group in turn, the rarest group first."""
    return E.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 7, 60).select("source", F.col("rn").cast("bigint").alias("rn"), "doc_id")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS r FROM (SELECT doc_id, source, lang, sha256('7:' || doc_id) AS h FROM documents)) WHERE r = 1) WHERE c <= 2")
def capped_sample(spark, d):
    """WIN-08: one per role, then at most two per employer."""
    return E.capped(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "source", 2, "doc_id", 7).select("doc_id")


@query("""WITH a AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20),
b AS (SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20),
c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20)
SELECT 'toxic' AS stratum, doc_id FROM a UNION ALL SELECT 'french', doc_id FROM b UNION ALL SELECT 'rest', doc_id FROM c""")
def stratified_draw(spark, d):
    """WIN-09: strata in order, each drawn from what is left."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    strata = [("toxic", docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")), ("french", docs.where("lang = 'fr'")), ("rest", docs)]
    return E.draw(strata, "doc_id", 7, 20)


@query("SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source")
def pool_concentration(spark, d):
    """AGG-22."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("all")))).select("source", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""SELECT user_id, round(sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))) / 12, 1) AS years FROM (SELECT user_id, lo, hi, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
FROM (SELECT user_id, event_id % 400 AS lo, event_id % 400 + CAST(trunc(value) AS BIGINT) % 30 AS hi FROM events)) GROUP BY user_id""")
def interval_union_months(spark, d):
    """AGG-13, WIN-05, DTE-06: overlapping spans count once."""
    lo = F.col("event_id") % 400
    spans = table(spark, d, "events").select("user_id", lo.alias("lo"), (lo + F.col("value").cast("bigint") % 30).alias("hi"))
    return C.years_worked(spans, "user_id")


@query("SELECT o_orderkey, y * 12 + m AS full, y * 12 + 1 AS start, y * 12 + 13 AS finish, CASE WHEN o_orderkey % 3 = 0 THEN 13 * 12 END AS width FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)")
def month_ordinals(spark, d):
    """DTE-05, DTE-06: a bare year begins in January and, as an end, reaches into the next one."""
    y, ym = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM")
    s = span(F.when(F.col("o_orderkey") % 3 == 0, y).otherwise("soon"), (y.cast("int") + 12).cast("string"), F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", month_ordinal(ym).alias("full"), month_ordinal(y).alias("start"), month_ordinal(y, end=True).alias("finish"), (s["hi"] - s["lo"]).alias("width"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def roles_newest_first(spark, d):
    """SRT-06: open roles before dated ones."""
    end = F.when(F.col("o_orderstatus") != "O", F.struct(F.col("o_orderdate"), -F.col("o_orderkey")))
    start = F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))
    return C.newest_first(table(spark, d, "orders"), "o_custkey", start, end).select("o_orderkey", F.col("place").cast("bigint").alias("place"))


_SKILLS = ["thre", "Thth", "erst", "thnd", "anea"]
_HITS = " + ".join(rf"CAST(regexp_matches(h, '(?i)(^|[^\p{{L}}\p{{N}}_]){s.lower()}([^\p{{L}}\p{{N}}_]|$)') AS INT)" for s in _SKILLS)


@query(f"WITH {POSTINGS_SQL}, s AS (SELECT id, company, lower(trim(title)) AS role, {_HITS} AS hits FROM (SELECT *, concat_ws(' ', title, left(coalesce(description, ''), 4000)) AS h FROM postings)), r AS (SELECT *, row_number() OVER (PARTITION BY company, role ORDER BY hits DESC, CAST(id AS VARCHAR)) AS r FROM s WHERE hits >= 2) SELECT id, CAST(hits AS BIGINT) AS hits FROM r WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY company ORDER BY hits DESC, CAST(id AS VARCHAR)) <= 2")
def on_craft(spark, d):
    """FLT-21, AGG-21, WIN-08: postings that name two different skills or more; the best of a role, two of an employer."""
    return E.on_craft(postings(spark, d), _SKILLS).select("id", F.col("hits").cast("bigint").alias("hits"))
