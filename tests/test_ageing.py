"""Ageing by timers against the batch rule, run daily."""

import datetime as dt
import random

from pyspark.sql import functions as F

from postmill.operators import merge
from postmill.streaming import ageing as A
from postmill.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 12)
DAY = dt.timedelta(days=1)


def test_timers_close_what_a_daily_run_closes(spark, tmp_path):
    """Sightings at noon, runs at midnight: late dates, renewed ones, none, and postings that are seen again when they are too old."""
    r = random.Random(2)
    log = [(k, T0 + DAY * d, r.choice([None, None, T0 + DAY * (d - r.choice([0, 1, 3, 6]))])) for d in range(9) for k in range(14) if r.random() < 0.25]
    end = T0 + DAY * 9 - dt.timedelta(hours=12)
    state = {}
    for d in range(9):
        for k, seen, posted in log:
            if seen == T0 + DAY * d:
                state[k] = (posted, state.get(k, (None, seen))[1], None)
        now = T0 + DAY * d + dt.timedelta(hours=12)
        rows = spark.createDataFrame([(k, *v) for k, v in state.items()], "k bigint, posted_at timestamp, created_at timestamp, closed_at timestamp").coalesce(1)
        state = {x["k"]: (x["posted_at"], x["created_at"], x["closed_at"]) for x in merge.close_stale(rows, F.lit(True), now, days=3).collect()}
    for part in range(3):
        rows = [x for x in log if (x[1] - T0).days // 3 == part] + ([(-1, end, end)] if part == 2 else [])
        spark.createDataFrame(rows, "k bigint, seen timestamp, posted timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k bigint, seen timestamp, posted timestamp").parquet(f"{tmp_path}/in")
        out = A.ageing(stream, "k", "seen", "posted", days=3, late="0 seconds")
        got = jobs.latest_of_stream(out, ["k"], ["at", "step"], "t", str(tmp_path / "run"))
    closed = {x["k"]: x["change"] == "close" for x in got.collect()}
    assert closed.pop(-1) is False and closed == {k: v[2] is not None for k, v in state.items()} and 0 < sum(closed.values()) < len(closed)


def test_times_are_rounded_to_the_nearest_millisecond(spark, tmp_path):
    """Closings at a sighting, by a timer at the very watermark, and just after it, where parts of a millisecond count."""
    end = T0 + DAY * 4
    us = lambda n: dt.timedelta(microseconds=n)
    rows = [(1, T0 + us(775_927), T0 - DAY * 9), (2, T0 + us(1_400), None), (3, T0 + us(1_500), None), (4, T0 + us(1_499), T0 - DAY * 9), (-1, end + us(1_400), end + us(1_400))]
    spark.createDataFrame(rows, "k bigint, seen timestamp, posted timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k bigint, seen timestamp, posted timestamp").parquet(f"{tmp_path}/in")
    out = A.ageing(stream, "k", "seen", "posted", days=3, late="1 day")
    got = jobs.latest_of_stream(out, ["k"], ["at", "step"], "t", str(tmp_path / "run"))
    at = {x["k"]: x["at"] for x in got.where("change = 'close'").select("k", (F.unix_micros("at") - F.unix_micros(F.lit(T0))).alias("at")).collect()}
    assert at == {1: 776_000, 2: 3 * 86_400_000_000 + 1_000, 4: 1_000}
