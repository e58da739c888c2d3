"""Pages over matches, and state read back from an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def live(matches: DataFrame, pool: DataFrame, key: str = "job_id") -> DataFrame:
    return matches.join(pool, key)


def page(rows: DataFrame, score: str, created: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """Best first, unjudged last, newest first among equals."""
    return rows.orderBy(F.desc_nulls_last(score), F.desc(created), tie).offset(offset).limit(limit)


def page_after(rows: DataFrame, score: str, created: str, tie: str, limit: int, last: Row | None = None) -> DataFrame:
    """The page after the row ``last`` of the page before (none: the first one), in the order of ``page``: earlier pages are filtered out
    as they are read, not sorted and skipped. ``created`` and ``tie`` are never null, and ``tie`` is unique."""
    if last is not None:
        s, c, t = (F.lit(last[k]) for k in (score, created, tie))
        later = (F.col(created) < c) | ((F.col(created) == c) & (F.col(tie) > t))
        unjudged = F.col(score).isNull()
        rows = rows.where(unjudged & later if last[score] is None else unjudged | (F.col(score) < s) | ((F.col(score) == s) & later))
    return rows.orderBy(F.desc_nulls_last(score), F.desc(created), tie).limit(limit)


def latest_by(events: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key that has one; earlier ones are replaced whole, not merged."""
    last = F.max_by(F.struct(*keep), F.struct(*order))
    return events.where(key.isNotNull()).groupBy(key.alias("key")).agg(last.alias("last")).select("key", "last.*")


def with_documents(rows: DataFrame, documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each row with its documents as a sorted list."""
    lists = documents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("documents"))
    return rows.join(lists, key, "left")


EVENT = "user_id bigint, type string, payload_json string, created_at timestamp"


def append_events(rows: DataFrame, path: str) -> None:
    """Append (user_id, type, payload_json, created_at) rows to the audit log, which nothing rewrites; most events belong to no user."""
    kept = rows.select(F.col("user_id").cast("bigint").alias("user_id"), "type", "payload_json", F.col("created_at").cast("timestamp").alias("created_at"))
    kept.write.mode("append").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(path)


def has_key(payload: Column, key: str) -> Column:
    """Is the key there at all: absent is not zero."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def price(tokens: Column, per_million: Column) -> Column:
    return tokens * per_million / 1_000_000


def price_per_thousand(spent: Column, done: Column) -> Column:
    """Price of a thousand units of work; null where none was done."""
    return F.try_divide(spent * 1000, done)
