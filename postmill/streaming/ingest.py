"""Feeds merged into keyed state by a stream: diffs, closings, counters and the audit row of a batch are one version of a store.

A batch has what one or several sources delivered. Of each source the postings are merged as diffs; what was open and isn't
there any more is closed, if the source delivers all it has and this time not much less than before; how much that was is
kept as a counter, and an audit row says what was done. A batch that dies halfway leaves no trace of any of these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import diff_upsert
from ..operators.readmodel import EVENT
from ..schemas import schema
from .jobs import run_available, volume_ok
from .store import Store, Table

_TIMES = "created_at timestamp, updated_at timestamp, closed_at timestamp"
COUNTERS = "source string, fetched bigint, runs bigint, at timestamp"


class Ingest:
    """State of postings (``posting``: their columns, with source and external_id) in a folder, fed batch by batch.

    Batches have the posting's columns and ``fetched_at``. Of rows of one key the last by it counts, then the one whose columns are greatest.
    ``complete`` says of a batch's source whether it delivers all that it has (all do by default); ``floor`` is the share of the fetch before that a
    fetch must have to close anything."""

    key = ("source", "external_id")

    def __init__(self, spark: SparkSession, folder: str, posting: str, compare: str = "raw_json", complete: Column | None = None, floor: float = 0.5, parts: int = 1, rows: int = 1 << 20):
        self.posting = schema(posting).fieldNames()
        self.compare, self.floor = compare, floor
        self.complete = F.lit(True) if complete is None else complete
        state = T.StructType([*schema(posting).fields, *schema(_TIMES).fields, T.StructField("op", T.StringType())])
        self.store = Store(spark, folder, {
            "postings": Table(state, self.key, parts, rows), "counters": Table(schema(COUNTERS), ("source",)), "audit": Table(schema(EVENT))})

    def read(self, table: str = "postings", version: int | None = None) -> DataFrame:
        out = self.store.read(table, version)
        return out.drop("op") if table == "postings" else out

    def _judged(self, seen: DataFrame) -> DataFrame:
        """(source, fetched, previous, runs, may_close) of the sources of a batch."""
        counted = seen.groupBy("source").agg(F.count("*").alias("fetched")).join(self.store.read("counters").select("source", F.col("fetched").alias("previous"), "runs"), "source", "left")
        return counted.withColumn("may_close", volume_ok(F.col("previous"), F.col("fetched"), self.floor) & self.complete)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge a batch as version ``number``; nothing happens if that is done already, or if the batch is empty."""
        version = self.store.begin(number)
        if version is None:
            return
        rows = F.struct(*self.posting)
        # rows of one key in a batch become one before anything is shuffled by key
        seen = batch.groupBy(*self.key).agg(F.max_by(rows, F.struct("fetched_at", F.to_json(rows))).alias("r"), F.max("fetched_at").alias("fetched_at")).select("r.*", "fetched_at").persist()
        now = seen.agg(F.max("fetched_at")).first()[0]
        if now is None:
            seen.unpersist()
            return
        judged = self._judged(seen).persist()
        # a part without a key of the batch has something to close if it has any open row of a source that may close
        closing = judged.where("may_close").select("source", F.col("may_close").alias("__may"))
        open_rows = self.store.read("postings").where("closed_at IS NULL").join(closing, "source", "left_semi")

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            mutable = [c for c in self.posting if c not in self.key]
            current = old.drop("op").withColumn("__seen", F.lit(None).cast("boolean"))
            out = diff_upsert(current, new.withColumn("__seen", F.lit(True)), list(self.key), mutable, self.compare, now, reset=()).join(closing, "source", "left")
            gone = F.col("__seen").isNull() & F.col("closed_at").isNull() & F.col("__may").isNotNull()
            return out.withColumns({"closed_at": F.when(gone, F.lit(now)).otherwise(F.col("closed_at")), "op": F.when(gone, "close").otherwise(F.col("_op"))})

        new = self.store.merge(version, "postings", seen.select(*self.posting), merged, open_rows)
        named = {"insert": "inserted", "update": "updated", "close": "closed"}
        done = new.where("op <> 'unchanged'").groupBy("source").agg(*(F.count_if(F.col("op") == op).alias(n) for op, n in named.items()))
        done = judged.join(done, "source", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in named.values()})
        payload = F.to_json(F.struct("source", "fetched", *named.values(), "may_close"))
        self.store.append(version, "audit", done.select(F.lit(None).cast("bigint").alias("user_id"), F.lit("feed.ingested").alias("type"), payload.alias("payload_json"), F.lit(now).alias("created_at")))
        counts = judged.select("source", "fetched", (F.coalesce("runs", F.lit(0)) + 1).alias("runs"), F.lit(now).alias("at"))
        self.store.merge(version, "counters", counts, _replaced("source"))
        self.store.commit(version)
        judged.unpersist()
        seen.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All that the stream has, and stop."""
        run_available(stream, self.apply, checkpoint)

    def changes(self, before: int | None, after: int | None = None) -> DataFrame:
        """The change feed between two versions, with ``_change``."""
        return self.store.changes("postings", before, after, "closed_at", ("op",))


def _replaced(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of the batch, and the old ones that it has no key of."""
    return lambda old, new: old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
