"""Joins, the read model and the registry (JN, AGG, SRT, FLT-15)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookups import literal_map
from ..functions.text import slugify
from ..operators import readmodel as R
from ..operators import registry as G
from ..session import table
from .base import query

_SCORE = "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_totalprice AS BIGINT) % 101 END"


def _matches(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("score", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice").cast("bigint") % 101))


_SCORE = "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(trunc(o_totalprice) AS BIGINT) % 101 END"


@query(f"SELECT o_orderkey, c_mktsegment, {_SCORE} AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus = 'O' ORDER BY score DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 25")
def pipeline_page(spark, d):
    """JN-01, SRT-02, PRJ-10, FLT-22: one page of the ranked read model."""
    rows = R.live(_matches(spark, d).where("o_orderstatus = 'O'"), table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return R.page(rows, "score", "o_orderdate", "o_orderkey", 50, 25).select("o_orderkey", "c_mktsegment", "score")


@query(f"SELECT o_orderkey, score, 1 + CAST(floor((r - 1) / 40) AS INT) AS page FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, o_orderdate DESC, o_orderkey) AS r FROM (SELECT *, {_SCORE} AS score FROM orders)) WHERE r <= 120")
def pipeline_cursor(spark, d):
    """SRT-02: three pages, one after the other, each from the last row of the one before."""
    rows, last, out = _matches(spark, d).select("o_orderkey", "score", "o_orderdate"), None, None
    for number in (1, 2, 3):
        page = R.page_after(rows, "score", "o_orderdate", "o_orderkey", 40, last)
        last = page.tail(1)[0]
        named = page.select("o_orderkey", "score", F.lit(number).alias("page"))
        out = named if out is None else out.unionByName(named)
    return out


@query("SELECT o_orderstatus, count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def pipeline_total(spark, d):
    """AGG-03: totals of the same rows as the pages."""
    return R.live(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("total"))


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_event_per_user(spark, d):
    """AGG-06, AGG-07, STM-06."""
    return R.latest_by(table(spark, d, "events"), F.col("user_id"), ["ts", "event_id"], ["event_type", "event_id"])


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS key, arg_max(event_type, event_id) AS event_type, arg_max(user_id, event_id) AS user_id FROM events WHERE event_type <> 'view' GROUP BY 1")
def latest_status_by_json_key(spark, d):
    """JN-12, JSN-01, JSN-02."""
    e = table(spark, d, "events").where((F.col("event_type") != "view") & R.has_key(F.col("props"), "k"))
    return R.latest_by(e, F.get_json_object("props", "$.k").cast("bigint"), ["event_id"], ["event_type", "user_id"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer")
def exists_flag(spark, d):
    """FLT-02, JN-04: EXISTS in a projection."""
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("SELECT count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents WHERE doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= DATE '2000-01-01')")
def semi_candidates(spark, d):
    """JN-03."""
    ids = table(spark, d, "lineitem").where("l_shipdate >= DATE'2000-01-01'").select(F.col("l_orderkey").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(ids, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


@query("SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def documents_per_match(spark, d):
    """JN-11, SRT-05."""
    rows = R.with_documents(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber", "l_partkey"])
    return rows.select("o_orderkey", F.nullif(F.array_join(F.transform("documents", lambda x: x["l_linenumber"].cast("string")), ","), F.lit("")).alias("lines"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 3 ORDER BY n DESC, p_name LIMIT 40")
def grow_candidates(spark, d):
    """AGG-01."""
    return G.candidates(table(spark, d, "part"), "p_name", 3, 40)


@query("SELECT DISTINCT p_name FROM part WHERE regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') NOT IN (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_shipdate > TIMESTAMP '2002-06-01' - INTERVAL 300 DAY AND l_quantity = 50)")
def cache_anti_window(spark, d):
    """FLT-15: a name whose slug failed lately is not tried again."""
    p = table(spark, d, "part")
    tried = p.join(table(spark, d, "lineitem").where("l_quantity = 50"), p.p_partkey == F.col("l_partkey")).select(slugify(F.col("p_name")).alias("slug"), F.col("l_shipdate").alias("tried_at"))
    return G.without_recent(p.select("p_name").distinct(), "p_name", tried, dt.datetime(2002, 6, 1), 300)


@query("SELECT o_orderkey, coalesce(nullif(o_custkey % 5, 1), s_suppkey) AS company_id FROM orders LEFT JOIN supplier ON s_name = 'Supplier#' || printf('%09d', o_custkey)")
def link_by_name(spark, d):
    """DML-16: fill unlinked rows by exact name."""
    o = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(1)).alias("company_id"), F.concat(F.lit("Supplier#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("company"))
    return G.link(o, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).select("o_orderkey", "company_id")


@query("SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY rn) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3 GROUP BY l_suppkey")
def payload_sample_top3(spark, d):
    """JN-10, WIN-04."""
    rn = F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey"))
    top = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", rn.alias("rn")).where("rn <= 3")
    return top.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_orderkey"))), lambda x: x["l_orderkey"].cast("string")), ",").alias("latest"))


@query("SELECT o_orderpriority, CAST(sum(l_quantity) AS BIGINT) AS tokens, count(*) AS calls FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def usage_tokens(spark, d):
    """AGG-05."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.sum("l_quantity").cast("bigint").alias("tokens"), F.count("*").alias("calls"))


_PRICES = {"F": 0.27, "O": 1.1, "P": 0.02}


@query("SELECT o_orderpriority, round(sum(l_quantity * CASE o_orderstatus WHEN 'F' THEN 0.27 WHEN 'O' THEN 1.1 ELSE 0.02 END) / 1000000, 9) AS spent, CASE WHEN count(*) FILTER (WHERE l_linenumber > 3) > 0 THEN round(sum(l_quantity * CASE o_orderstatus WHEN 'F' THEN 0.27 WHEN 'O' THEN 1.1 ELSE 0.02 END) / 1000000 * 1000 / count(*) FILTER (WHERE l_linenumber > 3), 9) END AS per_thousand FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def price_per_thousand(spark, d):
    """MTH-06: tokens of each kind at its price per million, per thousand of what reached the model."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    spent = F.sum(R.price(F.col("l_quantity").cast("double"), F.try_element_at(literal_map(_PRICES), "o_orderstatus")))
    per = j.groupBy("o_orderpriority").agg(spent.alias("spent"), F.count_if(F.col("l_linenumber") > 3).alias("done"))
    return per.select("o_orderpriority", F.round("spent", 9).alias("spent"), F.round(R.price_per_thousand(F.col("spent"), F.col("done")), 9).alias("per_thousand"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def oldest_first_queue(spark, d):
    """SRT-03."""
    return table(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def list_page(spark, d):
    """SRT-04, SRC-19: a plain page, ordered by key."""
    return table(spark, d, "part").orderBy("p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("SELECT a.conv_id, a.turn, b.text = a.text AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def zip_by_position(spark, d):
    """JN-18, SRT-08: two ordered lists joined on their positions."""
    c = table(spark, d, "conversations")
    return c.join(c.select("conv_id", "turn", F.col("text").alias("other")), ["conv_id", "turn"]).select("conv_id", "turn", (F.col("other") == F.col("text")).alias("same"))
