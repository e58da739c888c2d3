"""Keyed state (DML): two snapshots are made from one table by a mutation of its keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators.registry import seed_rows
from ..schemas import violations
from ..session import table
from .base import RUN, RUN_SQL, query

_KEY = ["source", "external_id"]
_COLS = ["source", "external_id", "title", "raw_json", "created_at", "updated_at", "closed_at", "dedupe_key"]


def _snapshots(spark, d):
    """Every order not divisible by 10 is stored, some closed; every one not divisible by 7 arrives, some changed, some twice."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    src, ext = F.col("o_orderstatus").alias("source"), F.concat(F.col("o_orderstatus"), F.lit(":"), F.col("k").cast("string")).alias("external_id")
    raw = lambda p, a: F.format_string(a, "k", p).alias("raw_json")
    current = o.where("k % 10 <> 0").select(src, ext, F.col("o_orderpriority").alias("title"), raw(F.col("o_orderpriority"), '{"k": %d, "p": "%s"}'), F.col("o_orderdate").cast("timestamp").alias("created_at"),
                                            F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.when(F.col("k") % 9 == 0, F.lit(RUN)).alias("closed_at"), F.lit("key").alias("dedupe_key"))
    fresh = F.when(F.col("k") % 4 == 0, "changed").otherwise(F.col("o_orderpriority"))
    first = o.where("k % 7 <> 0").select(src, ext, fresh.alias("title"), F.format_string('{"p":"%s",  "k":%d}', fresh, "k").alias("raw_json"), F.lit(0).alias("arrival"))
    again = o.where("k % 7 <> 0 AND k % 13 = 0").select(src, ext, F.lit("second").alias("title"), F.format_string('{"p":"second","k":%d}', "k").alias("raw_json"), F.lit(1).alias("arrival"))
    return current, M.last_of_batch(first.unionByName(again), _KEY, "arrival")


def _merged(spark, d):
    current, batch = _snapshots(spark, d)
    return M.diff_upsert(current, batch, _KEY, ["title", "raw_json"], "raw_json", RUN)


_PREP = """c AS (SELECT o_orderkey AS k, o_orderstatus AS source, o_orderpriority AS title, o_orderkey % 9 = 0 AS closed FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS k, o_orderstatus AS source, CASE WHEN o_orderkey % 13 = 0 THEN 'second' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE o_orderpriority END AS title FROM orders WHERE o_orderkey % 7 <> 0),
m AS (SELECT coalesce(c.source, b.source) AS source, coalesce(c.k, b.k) AS k, CASE WHEN c.k IS NULL THEN 'insert' WHEN b.k IS NOT NULL AND (b.title <> c.title OR c.closed) THEN 'update' ELSE 'unchanged' END AS op,
 c.title AS old, b.title AS fresh, c.closed FROM c FULL JOIN b ON c.k = b.k)"""


@query(f"WITH {_PREP} SELECT source || ':' || k AS external_id, op, CASE WHEN op = 'unchanged' THEN old ELSE fresh END AS title, coalesce(op = 'unchanged' AND closed, false) AS closed, op = 'unchanged' AS keyed FROM m")
def diff_upsert_ops(spark, d):
    """DML-01, STM-05, JSN-03, JN-06: what a batch does to every row."""
    m = _merged(spark, d)
    return m.select("external_id", F.col("_op").alias("op"), "title", F.col("closed_at").isNotNull().alias("closed"), F.col("dedupe_key").isNotNull().alias("keyed"))


@query(f"WITH {_PREP} SELECT op, count(*) AS n FROM m GROUP BY op")
def diff_upsert_counts(spark, d):
    """DML-01, AGG-04."""
    return M.op_counts(_merged(spark, d)).withColumnRenamed("_op", "op")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def batch_last_wins(spark, d):
    """AGG-09, STM-03."""
    return M.last_of_batch(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "role", "turn")


def _open(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("posted_at"), F.lit(RUN).alias("created_at"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(RUN)).alias("closed_at"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 9 = 0 OR (o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))) AS closed FROM orders GROUP BY 1")
def close_missing(spark, d):
    """DML-02, DML-03."""
    seen = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    done = M.close_missing(_open(spark, d), seen, ["o_orderkey"], F.col("o_orderstatus") == "O", RUN)
    return done.groupBy("o_orderstatus").agg(F.count("closed_at").alias("closed"))


@query(f"SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 9 = 0 OR (o_orderstatus = 'F' AND o_orderdate < {RUN_SQL} - INTERVAL 1200 DAY)) AS closed FROM orders GROUP BY 1")
def close_stale(spark, d):
    """DML-05, DTE-04, DTE-07, DTE-08."""
    done = M.close_stale(_open(spark, d), F.col("o_orderstatus") == "F", RUN, 1200)
    return done.groupBy("o_orderstatus").agg(F.count("closed_at").alias("closed"))


@query("SELECT coalesce(c.o_orderkey, b.k) AS k, CASE WHEN b.k IS NOT NULL AND (c.o_orderkey IS NULL OR c.o_orderstatus IN ('O', 'P')) THEN b.s ELSE c.o_orderstatus END AS status FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) c FULL JOIN (SELECT DISTINCT l_orderkey AS k, 'X' AS s FROM lineitem WHERE l_returnflag = 'R') b ON c.o_orderkey = b.k")
def conditional_upsert(spark, d):
    """DML-09."""
    current = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    batch = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit("X").alias("status")).distinct()
    return M.conditional_upsert(current, batch, ["k"], "status", ["O", "P"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_absent(spark, d):
    """DML-10, JN-05."""
    return M.insert_absent(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT ats_type, ats_slug, name FROM (SELECT 'lever' AS ats_type, lower(replace(s_name, '#', '-')) AS ats_slug, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT * FROM (VALUES ('lever', 'supplier-000000002', 'Seed two'), ('ashby', 'Linear', 'Linear'), ('greenhouse', 'figma', 'Figma')) v WHERE v.col1 NOT IN (SELECT lower(replace(s_name, '#', '-')) FROM supplier WHERE s_suppkey % 2 = 0))")
def seed_boards(spark, d):
    """SRC-20, DML-10: literal boards, inserted where the registry has none of that kind and slug."""
    known = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.lit("lever").alias("ats_type"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("ats_slug"), F.col("s_name").alias("name"), F.lit("active").alias("status"))
    seeds = seed_rows(spark, [("lever", "supplier-000000002", "Seed two"), ("ashby", "Linear", "Linear"), ("greenhouse", "figma", "Figma")])
    return known.unionByName(M.insert_absent(known, seeds, ["ats_type", "ats_slug"])).select("ats_type", "ats_slug", "name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(s_acctbal AS DOUBLE) END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0")
def crud_patch_delete(spark, d):
    """DML-18: only what a change names is set, a named null too; then rows are deleted by key."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    third = F.col("s_suppkey") % 3
    payload = F.when(third == 0, F.concat(F.lit('{"s_name": "new '), F.col("s_suppkey").cast("string"), F.lit('", "s_acctbal": -1}'))).otherwise('{"s_name": null}')
    changes = s.where("s_suppkey % 3 <> 1").select("s_suppkey", payload.alias("payload"))
    return M.delete(M.patch(s, changes, "s_suppkey", ["s_name", "s_acctbal"]), s.where("s_suppkey % 5 = 0"), "s_suppkey")


@query("SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '0') AS BIGINT) % 2 AS k, event_type AS kind, user_id AS added FROM events")
def json_shallow_merge(spark, d):
    """JSN-04: the right object's values replace the left's, whole; the rest stays."""
    right = F.to_json(F.struct((F.get_json_object("props", "$.k").cast("bigint") % 2).alias("k"), F.struct(F.col("event_type").alias("kind")).alias("nested"), F.col("user_id").alias("added")))
    left = F.to_json(F.struct(F.lit("old").alias("k"), F.struct(F.lit("gone").alias("other")).alias("nested")))
    merged = M.shallow_merge(left, right)
    rows = table(spark, d, "events").select("event_id", merged.alias("m"), F.get_json_object(merged, "$.nested.other").alias("gone")).where("gone IS NULL")
    return rows.select("event_id", F.get_json_object("m", "$.k").cast("bigint").alias("k"), F.get_json_object("m", "$.nested.kind").alias("kind"), F.get_json_object("m", "$.added").cast("bigint").alias("added"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'P' WHEN 'P' THEN 'F' ELSE o_orderstatus END ELSE o_orderstatus END AS status, o_custkey % 2 = 0 AND o_orderstatus IN ('O', 'P') AS affected FROM orders")
def cas_transition(spark, d):
    """DML-12."""
    rows = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status")
    return M.compare_and_set(rows, "status", {"O": "P", "P": "F"}, F.col("o_custkey") % 2 == 0).select("o_orderkey", "status", "affected")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'd' || s_suppkey END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'fresh' END ELSE 'old' END AS note FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 'old' FROM supplier WHERE s_suppkey % 2 = 1")
def coalesce_registry(spark, d):
    """DML-11, DML-15, DML-17: nulls never erase."""
    s = table(spark, d, "supplier")
    current = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("domain"), F.lit("old").alias("note"))
    gap = F.col("s_suppkey") % 3 == 0
    batch = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.when(~gap, F.concat(F.lit("d"), F.col("s_suppkey").cast("string"))).alias("domain"), F.when(~gap, "fresh").alias("note"))
    return M.coalesce_upsert(current, batch, ["k"], ["domain"])


@query("""WITH cur AS (SELECT conv_id, role AS kind, text, turn AS pos, CASE WHEN turn % 3 = 0 THEN 'user' ELSE 'parsed' END AS origin FROM conversations),
new AS (SELECT conv_id, role AS kind, upper(text) AS text, turn AS pos, 'parsed' AS origin FROM conversations WHERE conv_id % 2 = 0),
allrows AS (SELECT *, 0 AS f FROM cur WHERE origin = 'user' OR conv_id % 2 = 1 UNION ALL SELECT *, 1 FROM new)
SELECT origin, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind, text ORDER BY f, pos) AS r FROM allrows) WHERE r = 1 GROUP BY origin""")
def rebuild_keep_user(spark, d):
    """DML-13, AGG-08."""
    c = table(spark, d, "conversations").withColumnsRenamed({"role": "kind", "turn": "pos"})
    current = c.withColumn("origin", F.when(F.col("pos") % 3 == 0, "user").otherwise("parsed"))
    parsed = c.where("conv_id % 2 = 0").withColumn("text", F.upper("text")).withColumn("origin", F.lit("parsed"))
    return M.rebuild(current, parsed, "conv_id", ["kind", "text"]).groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE k % 2 = 0) AS differ, count(*) FILTER (WHERE k % 2 <> 0) AS same FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def json_semantic_diff(spark, d):
    """JSN-03: key order and blanks don't count."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    one, two = F.format_string('{"k": %d, "z": [1, 2]}', k), F.format_string('{"z":[1,2],"k":%d}', k + F.when(k % 2 == 0, 1).otherwise(0))
    same = M.canonical_json(one).eqNullSafe(M.canonical_json(two))
    return table(spark, d, "events").agg(F.count_if(~same).alias("differ"), F.count_if(same).alias("same"))


@query("SELECT s_suppkey, CASE WHEN f IS NULL THEN s_suppkey % 6 WHEN f = 0 THEN 0 ELSE s_suppkey % 6 + 1 END AS failures, CASE WHEN f > 0 AND s_suppkey % 6 + 1 >= 5 THEN 'retired' ELSE 'active' END AS status FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_acctbal > 5000 THEN 0 ELSE 1 END AS f FROM supplier)")
def failure_counter(spark, d):
    """DML-14."""
    s = table(spark, d, "supplier")
    rows = s.select("s_suppkey", (F.col("s_suppkey") % 6).alias("failures"), F.lit("active").alias("status"))
    outcome = s.where("s_suppkey % 4 <> 3").select("s_suppkey", (F.col("s_acctbal") > 5000).alias("ok"))
    return M.count_failures(rows, outcome, "s_suppkey")


@query("SELECT count(*) FILTER (WHERE c.c_custkey IS NULL) AS nulled, count(*) FILTER (WHERE c.c_custkey IS NOT NULL) AS kept FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def fk_delete_actions(spark, d):
    """DML-19: SET NULL and CASCADE when a third of the parents go."""
    o, parents = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_custkey % 3 <> 0")
    nulled = M.null_dangling(o, parents, "o_custkey", "c_custkey").agg(F.count_if(F.col("o_custkey").isNull()).alias("nulled"))
    return nulled.crossJoin(M.cascade(o, parents, "o_custkey", "c_custkey").agg(F.count("*").alias("kept")))


@query("SELECT 'quality' AS \"check\", count(*) FILTER (WHERE quality NOT IN (1)) AS n FROM labels UNION ALL SELECT 'toxic', 0 FROM labels GROUP BY 2 UNION ALL SELECT 'unique(doc_id)', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)")
def constraint_violations(spark, d):
    """Constraints of the data model: closed vocabularies and unique keys."""
    return violations(table(spark, d, "labels"), {"quality": F.col("quality").isin(1), "toxic": F.col("toxic").isin(0, 1)}, ["doc_id"])
