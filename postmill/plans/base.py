"""Registration of queries, and the bindings of the given tables to postings, matches and logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The run's own time: one constant for every row.
RUN = dt.datetime(2024, 6, 1)
RUN_SQL = "TIMESTAMP '2024-06-01 00:00:00'"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB SQL."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


#: Documents as postings: the first line is the title, the source the employer, the language the place.
POSTINGS_SQL = """postings AS (
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, source AS company, lang AS location,
  CASE WHEN doc_id % 9 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 4 = 0 THEN [lang || ', ' || source, 'elsewhere'] ELSE [lang] END AS locations,
  CASE doc_id % 5 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS remote_mode,
  doc_id % 11 = 0 AS closed, doc_id % 13 = 5 AS duplicate FROM documents)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("description"), F.col("source").alias("company"), F.col("lang").alias("location"),
        F.when(i % 9 == 0, F.array().cast("array<string>")).when(i % 4 == 0, F.array(F.concat_ws(", ", "lang", "source"), F.lit("elsewhere"))).otherwise(F.array("lang")).alias("locations"),
        F.when(i % 5 == 0, "remote").when(i % 5 == 1, "hybrid").when(i % 5 == 2, "onsite").alias("remote_mode"),
        F.when(i % 11 == 0, F.lit(RUN)).alias("closed_at"), F.when(i % 13 == 5, i - 1).alias("canonical_id"))


WORD = r"\p{L}\p{N}_"
def squash_sql(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '', 'g')"
