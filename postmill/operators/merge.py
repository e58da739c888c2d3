"""Keyed state: snapshots in, next snapshot out. Nothing is updated in place; a caller writes the result to a new path."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_json(col: Column) -> Column:
    """Equal for JSON texts that differ in key order or spacing only; a text that is no JSON stands for itself."""
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


def shallow_merge(left: Column, right: Column) -> Column:
    """Two JSON objects as one; of equal keys the right one's value stays, whole. What is no object adds nothing."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    ours = F.map_filter(parsed(left), lambda k, _: ~F.array_contains(F.map_keys(parsed(right)), k))
    return F.to_json(F.map_concat(ours, parsed(right)))


def last_of_batch(batch: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The last row of each key."""
    last = W.partitionBy(*key).orderBy(F.desc(arrival))
    return batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def diff_upsert(current: DataFrame, batch: DataFrame, key: list[str], mutable: list[str], compare: str, run: dt.datetime,
                closed: str = "closed_at", reset: tuple[str, ...] = ("dedupe_key",)) -> DataFrame:
    """The next snapshot with ``_op``: insert, update or unchanged.

    A row is updated if ``compare`` differs as JSON, or if it was closed; then the mutable columns are
    taken from the batch, ``updated_at`` is set, ``closed`` and ``reset`` are cleared and ``created_at``
    stays. One shuffle, by key, for both sides.
    """
    now = F.lit(run)
    b, c = batch.alias("b"), current.alias("c")
    on = [F.col(f"b.{k}") == F.col(f"c.{k}") for k in key]
    joined = c.join(b, on, "full_outer")
    seen, known = F.col(f"b.{key[0]}").isNotNull(), F.col(f"c.{key[0]}").isNotNull()
    ours, theirs = F.col(f"c.{compare}"), F.col(f"b.{compare}")
    # most rows have the very text that they had, which is not parsed then
    differs = F.when(theirs.eqNullSafe(ours), False).otherwise(~canonical_json(theirs).eqNullSafe(canonical_json(ours))) | F.col(f"c.{closed}").isNotNull()
    op = F.when(~known, "insert").when(seen & differs, "update").otherwise("unchanged")
    joined = joined.withColumn("_op", op)
    taken = F.col("_op") != "unchanged"
    out = []
    for name in current.columns:
        old = F.col(f"c.{name}")
        if name in key:
            new = F.coalesce(old, F.col(f"b.{name}"))
        elif name in mutable:
            new = F.when(taken, F.col(f"b.{name}")).otherwise(old)
        elif name == closed or name in reset:
            new = F.when(F.col("_op") == "unchanged", old)
        elif name == "created_at":
            new = F.coalesce(old, now)
        elif name == "updated_at":
            new = F.when(taken, now).otherwise(old)
        else:
            new = F.coalesce(F.col(f"b.{name}"), old) if name in batch.columns else old
        out.append(new.alias(name))
    return joined.select(*out, "_op")


def op_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("_op").agg(F.count("*").alias("n"))


def close_missing(current: DataFrame, seen: DataFrame, key: list[str], scope: Column, run: dt.datetime, closed: str = "closed_at") -> DataFrame:
    """Close the open rows of ``scope`` that were not seen. Nothing seen closes nothing: an empty fetch is no evidence."""
    if seen.isEmpty():
        return current
    there = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    gone = scope & F.col(closed).isNull() & F.col("__seen").isNull()
    return current.join(there, key, "left").withColumn(closed, F.when(gone, F.lit(run)).otherwise(F.col(closed))).drop("__seen").select(*current.columns)


def close_stale(current: DataFrame, scope: Column, run: dt.datetime, days: int = 45, posted: str = "posted_at", created: str = "created_at", closed: str = "closed_at") -> DataFrame:
    """Close open rows of ``scope`` that were posted, or else created, more than ``days`` ago."""
    old = scope & F.col(closed).isNull() & (F.coalesce(posted, created) < F.lit(run - dt.timedelta(days=days)))
    return current.withColumn(closed, F.when(F.coalesce(old, F.lit(False)), F.lit(run)).otherwise(F.col(closed)))


def conditional_upsert(current: DataFrame, batch: DataFrame, key: list[str], state: str, open_states: list[str]) -> DataFrame:
    """Insert new keys; overwrite known ones only while their state is one of ``open_states``."""
    b, c = batch.alias("b"), current.alias("c")
    joined = c.join(b, [F.col(f"b.{k}") == F.col(f"c.{k}") for k in key], "full_outer")
    take = F.col(f"b.{key[0]}").isNotNull() & (F.col(f"c.{key[0]}").isNull() | F.coalesce(F.col(f"c.{state}").isin(open_states), F.lit(False)))
    return joined.select(*[(F.coalesce(F.col(f"c.{n}"), F.col(f"b.{n}")) if n in key else F.when(take, F.col(f"b.{n}")).otherwise(F.col(f"c.{n}"))).alias(n) for n in current.columns])


def insert_absent(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch whose key is new, to be appended."""
    return batch.join(current.select(*key), key, "left_anti").select(*batch.columns)


def compare_and_set(rows: DataFrame, state: str, moves: dict[str, str], where: Column | None = None) -> DataFrame:
    """Move rows from an expected state to the next; ``affected`` tells which moved. A second run moves nothing."""
    expected = F.col(state).isin(list(moves)) & (F.lit(True) if where is None else where)
    to = F.coalesce(*(F.when(F.col(state) == a, b) for a, b in moves.items()))
    return rows.withColumn("affected", F.coalesce(expected, F.lit(False))).withColumn(state, F.when(F.col("affected"), to).otherwise(F.col(state)))


def patch(current: DataFrame, changes: DataFrame, key: str, columns: list[str], payload: str = "payload") -> DataFrame:
    """Set the columns that a row's change (key, payload as JSON) names, to null where it says null; what it doesn't name stays."""
    joined = current.join(changes.select(key, F.col(payload).alias("__p")), key, "left")
    named = lambda c: F.coalesce(F.array_contains(F.json_object_keys("__p"), c), F.lit(False))
    new = {c: F.when(named(c), F.get_json_object("__p", f"$.{c}").cast(current.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*current.columns)


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key), key, "left_anti").select(*current.columns)


def coalesce_upsert(current: DataFrame, batch: DataFrame, key: list[str], sticky: list[str]) -> DataFrame:
    """Upsert in which a null of the batch never erases a known value of ``sticky`` columns."""
    b, c = batch.alias("b"), current.alias("c")
    joined = c.join(b, [F.col(f"b.{k}") == F.col(f"c.{k}") for k in key], "full_outer")
    seen = F.col(f"b.{key[0]}").isNotNull()
    keep = lambda n: F.coalesce(F.col(f"b.{n}"), F.col(f"c.{n}")) if n in sticky + key else F.when(seen, F.col(f"b.{n}")).otherwise(F.col(f"c.{n}"))
    return joined.select(*[keep(n).alias(n) for n in current.columns])


def rebuild(current: DataFrame, parsed: DataFrame, owner: str, unique: list[str], origin: str = "origin", kept: str = "user") -> DataFrame:
    """Replace the parsed rows of the owners in ``parsed``, keep their ``kept`` rows; of equal ones the kept, then the earliest ``pos``, stays."""
    ours = parsed.select(owner).distinct()
    stay = current.where(F.col(origin) == kept).unionByName(current.where(F.col(origin) != kept).join(ours, owner, "left_anti").select(*current.columns))
    both = stay.withColumn("__new", F.lit(0)).unionByName(parsed.select(*current.columns).withColumn("__new", F.lit(1)))
    first = W.partitionBy(owner, *unique).orderBy("__new", "pos")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*current.columns)


def count_failures(rows: DataFrame, outcome: DataFrame, key: str, retire_at: int = 5) -> DataFrame:
    """Consecutive failures: a success sets them to zero, a failure adds one, ``retire_at`` of them retire the row."""
    joined = rows.join(outcome.select(key, "ok"), key, "left")
    n = F.when(F.col("ok").isNull(), F.col("failures")).when(F.col("ok"), 0).otherwise(F.col("failures") + 1)
    return joined.withColumn("failures", n).withColumn("status", F.when((F.col("ok") == F.lit(False)) & (F.col("failures") >= retire_at), "retired").otherwise(F.col("status"))).select(*rows.columns)


def null_dangling(rows: DataFrame, parents: DataFrame, ref: str, key: str) -> DataFrame:
    """SET NULL: references to parents that are gone."""
    there = parents.select(F.col(key).alias("__p")).distinct()
    return rows.join(there, F.col(ref) == F.col("__p"), "left").withColumn(ref, F.col("__p")).drop("__p")


def cascade(rows: DataFrame, parents: DataFrame, ref: str, key: str) -> DataFrame:
    """CASCADE: rows whose parent is there, or that have none."""
    there = parents.select(F.col(key).alias(ref)).distinct()
    return rows.where(F.col(ref).isNull()).unionByName(rows.join(there, ref, "left_semi").select(*rows.columns))
