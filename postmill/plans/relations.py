"""Interval joins between tables, deletes over a graph of tables, unique keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, references
from ..session import shared_path, table
from .base import query


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, epoch(CAST(l_shipdate AS TIMESTAMP)) / 86400 AS lo, epoch(CAST(l_shipdate AS TIMESTAMP)) / 86400 + 3 * l_linenumber AS hi FROM lineitem),
b AS (SELECT o_orderkey, o_custkey, epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 AS lo, epoch(CAST(o_orderdate AS TIMESTAMP)) / 86400 + o_orderkey % 3 + CASE WHEN o_orderkey % 50 = 0 THEN 400 ELSE 0 END AS hi FROM orders)
SELECT l_suppkey AS k, count(*) AS n, CAST(sum(o_orderkey % 1000) AS BIGINT) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM a JOIN b ON a.l_suppkey = b.o_custkey AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY l_suppkey""")
def interval_join(spark, d):
    """JN-17, BAR-05: windows of one table that overlap those of another, a few of which are very long."""
    days = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01"))
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber", days("l_shipdate").alias("lo")).withColumn("hi", F.col("lo") + 3 * F.col("l_linenumber"))
    key = F.col("o_orderkey")
    more = key % 3 + F.when(key % 50 == 0, 400).otherwise(0)
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", days("o_orderdate").alias("lo")).withColumn("hi", F.col("lo") + more)
    pairs = intervals.overlaps(a, b, "lo", "hi", 8, ("k",))
    return pairs.groupBy(F.col("l.k").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("r.o_orderkey") % 1000).alias("total"), F.sum("l.l_linenumber").cast("bigint").alias("lines"))


_KEYS = [references.ForeignKey("nation", "n_regionkey", "region", "r_regionkey", references.CASCADE), references.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey", references.CASCADE),
         references.ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey", references.SET_NULL), references.ForeignKey("orders", "o_custkey", "customer", "c_custkey", references.CASCADE),
         references.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", references.CASCADE), references.ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey", references.SET_NULL)]
_IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "line"}


@query("""WITH s0 AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT CASE WHEN l_suppkey NOT IN (FROM s0) THEN l_suppkey END AS l_suppkey FROM lineitem WHERE l_orderkey IN (FROM o)), s AS (SELECT CASE WHEN s_nationkey IN (FROM n) THEN s_nationkey END AS k FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT 'region' AS name, count(*) AS n, 0 AS nulls FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', count(*), 0 FROM n UNION ALL SELECT 'customer', count(*), 0 FROM c UNION ALL SELECT 'orders', count(*), 0 FROM o
UNION ALL SELECT 'lineitem', count(*), count(*) - count(l_suppkey) FROM l UNION ALL SELECT 'supplier', count(*), count(*) - count(k) FROM s""")
def fk_delete_graph(spark, d):
    """DML-19: a region and a quarter of the suppliers are deleted, with what cascades over four tables, and nulls elsewhere."""
    tables = {t: table(spark, d, t) for t in _IDS if t != "lineitem"}
    tables["lineitem"] = table(spark, d, "lineitem").withColumn("line", F.concat_ws(":", "l_orderkey", "l_linenumber"))

    def write(rows, what):
        path = shared_path(spark, what)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    left = references.delete_cascading(tables, {"region": tables["region"].where("r_regionkey = 1"), "supplier": tables["supplier"].where("s_suppkey % 4 = 0")}, _KEYS, _IDS, write)
    nulls = {"lineitem": "l_suppkey", "supplier": "s_nationkey"}
    out = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n"), (F.count_if(F.col(nulls[name]).isNull()) if name in nulls else F.lit(0)).cast("bigint").alias("nulls")).select(F.lit(name).alias("name"), "n", "nulls")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH new AS (SELECT c_custkey + 10 AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 50 END AS slot, c_name FROM customer), twice AS (SELECT slot FROM new WHERE slot IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'c_custkey' WHEN slot IN (FROM twice) OR slot IN (SELECT c_custkey % 9 FROM customer WHERE c_custkey % 11 = 0) THEN 'slot' END AS conflict FROM new""")
def unique_violations(spark, d):
    """DML-18: new rows that a unique key refuses, by the first such key."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    new = c.select((k + 10).alias("c_custkey"), F.when(k % 7 != 0, k % 50).alias("slot"), "c_name")
    current = c.select("c_custkey", F.when(k % 11 == 0, k % 9).alias("slot"), "c_name")
    taken, refused = references.insert_unique(current, new, [["c_custkey"], ["slot"]])
    return taken.select("c_custkey", F.lit(None).cast("string").alias("conflict")).unionByName(refused.select("c_custkey", "conflict"))
