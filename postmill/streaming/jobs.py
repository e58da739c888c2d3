"""Incremental jobs on Structured Streaming: each run takes what is new and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_path
from .store import Store, Table


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything there is in micro-batches, then stop; a rerun from the same checkpoint sees only what came since."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str) -> StreamingQuery:
    """Process what has come at every interval, such as "6 hours", until the query is stopped; it can go on from its checkpoint."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


class Snapshot:
    """One keyed table of a store: parts are rewritten where a batch has keys of them, and split as they grow; ``parts``, a power of two, is where it begins.

    A batch that comes again after its version was done changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, schema, key: list[str], parts: int = 1, rows: int = 1 << 20):
        self.spark, self.schema, self.key = spark, schema, key
        self.store = Store(spark, folder, {"rows": Table(schema, tuple(key), parts, rows)})

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        return self.store.versions()

    def holders(self) -> dict[int, int]:
        """For each part that has rows, by its first hash value, there is the version that wrote it."""
        return {p.start: p.version for p in self.store.parts("rows") if p.path}

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def replace(self, batch: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Write the version that ``merge`` (old rows, new rows) gives for the parts that the batch has keys of."""
        new = self.store.begin(version)
        if new is not None:
            self.store.merge(new, "rows", batch.select(*self.schema.fieldNames()), merge)
            self.store.commit(new)


def merge_latest(snapshot: Snapshot, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch by batch, keep the last row of each key by ``order``; repeated or late rows change nothing."""
    last = F.max_by(F.struct(*snapshot.schema.fieldNames()), F.struct(*order))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*snapshot.key).agg(last.alias("__r")).select("__r.*")

    return lambda batch, number: snapshot.replace(batch, number, merge)


def latest_of_stream(stream: DataFrame, key: list[str], order: list[str], what: str, folder: str | None = None) -> DataFrame:
    """The state of ``merge_latest`` over all that the stream has, from where the folder's last run ended; a new folder by default."""
    spark = stream.sparkSession
    folder = folder or shared_path(spark, what)
    snapshot = Snapshot(spark, f"{folder}/state", stream.schema, key)
    run_available(stream, merge_latest(snapshot, order), f"{folder}/offsets")
    return snapshot.read()


def windowed_counts(rows: DataFrame, time: str, size: str, slide: str | None = None, late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per event-time window; with a stream, rows later than ``late`` are left out."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, size, slide or size), *by).agg(F.count("*").alias("n"))


def session_counts(rows: DataFrame, time: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def volume_ok(previous: Column, fetched: Column, floor: float = 0.5) -> Column:
    """May a run close what it did not see: not if it fetched less than a share of the run before."""
    return F.coalesce(fetched >= previous * floor, F.lit(True))


def gate_runs(runs: DataFrame, source: str, order: str, fetched: str) -> DataFrame:
    """Each run with the one before it, and whether it may close rows."""
    before = F.lag(fetched).over(W.partitionBy(source).orderBy(order))
    return runs.withColumn("previous", before).withColumn("may_close", volume_ok(F.col("previous"), F.col(fetched)))


def reasked(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Answers (key, met, missing) with ``asked_again``: where nothing was met and something missing, a second answer, if there is one, replaces the first."""
    again = (F.size("met") == 0) & (F.size("missing") > 0)
    other = second.select(key, F.struct("met", "missing").alias("__s"))
    out = first.withColumn("asked_again", again).join(other, key, "left")
    taken = F.col("asked_again") & F.col("__s").isNotNull()
    return out.withColumns({c: F.when(taken, F.col(f"__s.{c}")).otherwise(F.col(c)) for c in ("met", "missing")}).drop("__s")
