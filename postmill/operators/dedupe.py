"""Cross-source duplicates: one winner per key, by source priority, then age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookups import source_priority
from ..functions.text import dedupe_key


def fill_keys(jobs: DataFrame) -> DataFrame:
    """Open rows without a key get one, where they can have one."""
    key = dedupe_key(F.col("company"), F.col("title"), F.col("location"))
    return jobs.withColumn("dedupe_key", F.when(F.col("dedupe_key").isNull() & F.col("closed_at").isNull(), key).otherwise(F.col("dedupe_key")))


def winners(jobs: DataFrame, priority: Column | None = None) -> DataFrame:
    """``jobs`` with winner_source and winner_id: least priority, then id, of each key; a row without a key wins alone.

    The least of each key is aggregated before it is shuffled, and joined back, so that a hot key is no task of its own."""
    rank = source_priority(F.col("source")) if priority is None else priority
    keyed = jobs.where("dedupe_key IS NOT NULL")
    first = keyed.groupBy(F.col("dedupe_key").alias("__k")).agg(F.min(F.struct(rank.alias("p"), "id", "source")).alias("__w"))
    joined = jobs.join(first, F.col("dedupe_key") == F.col("__k"), "left")
    return joined.withColumns({"winner_source": F.coalesce("__w.source", "source"), "winner_id": F.coalesce("__w.id", "id")}).drop("__k", "__w")


def assign_canonical(jobs: DataFrame, priority: Column | None = None) -> DataFrame:
    """Open rows point at their key's winner; rows of the winner's own source never do. ``change``: duplicate, promoted or none."""
    open_rows = winners(jobs.where("closed_at IS NULL"), priority)
    new = F.when(F.col("source") == F.col("winner_source"), None).otherwise(F.nullif(F.col("winner_id"), F.col("id")))
    changed = ~new.eqNullSafe(F.col("canonical_id"))
    change = F.when(changed & new.isNotNull(), "duplicate").when(changed, "promoted").otherwise("none")
    done = open_rows.withColumn("change", change).withColumn("canonical_id", new).drop("winner_source", "winner_id")
    return done.unionByName(jobs.where("closed_at IS NOT NULL").withColumn("change", F.lit("none")))


def collapse(jobs: DataFrame, by: list[str], latest: str, id_col: str = "id") -> DataFrame:
    """Rows of one group point at the latest of them."""
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last(latest), id_col)
    return jobs.withColumns({"rn": F.row_number().over(order), "survivor": F.first(id_col).over(order)})
