"""Postings that age: keyed state with event-time timers closes what was posted too long ago, and opens it again when it is seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN, REOPEN, CLOSE = 0, 1, 2
#: Changes of a key, in the order in which those of one time happen.
CHANGES = ["open", "reopen", "close"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ages(StatefulProcessor):
    """Of each key: when it was first seen, when it was posted by its last sighting, or else first seen, in ms, and whether it is closed; one timer
    for when it is too old. All sightings of a key in one batch meet in one task.

    Sightings are taken by their time, so that the changes don't depend on how they were dealt into batches: one that comes after the
    limit closes the posting as of the limit first. Seen again, a posting opens, and closes at once if it is still too old."""

    def __init__(self, limit_ms: int, key: str):
        self.limit, self.key = limit_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("age", "first bigint, posted bigint, closed boolean")

    def _rows(self, key, changes: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key] * len(changes), "change": pd.Series([c for c, _ in changes], dtype="int32"), "at": pd.Series([a for _, a in changes], dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        first, posted, closed = known if known else (None, None, False)
        before, changes = posted, []
        seen = pd.concat(list(rows)).sort_values(["seen", "posted"], na_position="first")
        for at, said in zip(seen["seen"], seen["posted"]):
            at = int(at)
            if posted is None:
                changes.append((OPEN, at))
            elif not closed and posted + self.limit < at:
                changes.append((CLOSE, posted + self.limit))
                closed = True
            first = at if first is None else first
            posted = int(said) if pd.notna(said) else first
            if closed:
                changes.append((REOPEN, at))
                closed = False
            if posted + self.limit < at:
                changes.append((CLOSE, at))
                closed = True
        if before is not None and before != posted or closed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if not closed:
            # one that the watermark has passed already fires with the next batch
            self.handle.registerTimer(posted + self.limit)
        self.state.update((first, posted, closed))
        yield self._rows(key[0], changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, posted, closed = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not closed and posted + self.limit == at:
            self.state.update((first, posted, True))
            yield self._rows(key[0], [(CLOSE, at)])

    def close(self) -> None:
        pass


def ageing(sightings: DataFrame, key: str, seen: str, posted: str, days: float = 45, late: str = "1 day") -> DataFrame:
    """A stream of (key, change, at) for a stream of sightings: ``seen`` when, and ``posted`` when (null: not said). ``change`` is open, reopen or close.

    A posting closes when the watermark passes ``days`` after it was posted, or else first seen; sightings later than ``late`` are left out. Times are rounded to the
    nearest millisecond. State is as large as the keys are many; it needs the RocksDB state store, which is set for the session."""
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = sightings.schema[key].dataType.simpleString()
    # the nearest millisecond, of the watermark as well
    ms = lambda c: F.unix_millis(F.timestamp_micros(F.round(F.unix_micros(F.col(c).cast("timestamp")), -3)))
    rows = sightings.where(F.col(key).isNotNull() & F.col(seen).isNotNull()).select(F.col(key), F.timestamp_millis(ms(seen)).alias("at"), ms(posted).alias("posted"), ms(seen).alias("seen")).withWatermark("at", late)
    out = rows.groupBy(key).transformWithStateInPandas(_Ages(round(days * 86_400_000), key), f"{key} {kind}, change int, at bigint", "Append", "EventTime")
    return out.select(key, F.get(F.array(*map(F.lit, CHANGES)), "change").alias("change"), F.timestamp_millis("at").alias("at"), F.col("change").alias("step"))
