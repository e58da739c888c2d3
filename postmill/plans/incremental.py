"""Incremental processing (STM); names with ext_ are extensions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.asking import ask_all
from ..operators.readmodel import append_events, read_events
from ..session import shared_path, table
from ..streaming import jobs as J
from ..streaming.ageing import ageing
from ..streaming.ingest import Ingest
from .base import RUN, query


def _stream(spark, d):
    # as a pattern, the path may name one file as well as a folder
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


_LATEST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


@query(_LATEST)
def stream_foreachbatch_merge(spark, d):
    """STM-01..03, STM-08, STM-09: a stream merged into a keyed snapshot, batch by batch."""
    stream = _stream(spark, d).select("user_id", "event_id", "event_type")
    return J.latest_of_stream(stream, ["user_id"], ["event_id"], "latest")


@query(_LATEST)
def stream_periodic(spark, d):
    """STM-01: a query that looks for what has come at every interval, until it is stopped."""
    folder = shared_path(spark, "periodic")
    stream = _stream(spark, d).select("user_id", "event_id", "event_type")
    snapshot = J.Snapshot(spark, f"{folder}/state", stream.schema, ["user_id"])
    run = J.run_every(stream, J.merge_latest(snapshot, ["event_id"]), f"{folder}/offsets", "1 second")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return snapshot.read()


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def stream_audit_latest(spark, d):
    """STM-06: state read back from an append-only log by a JSON key."""
    stream = _stream(spark, d).where("event_type IN ('signup', 'purchase')").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id", F.col("event_type").alias("status"))
    return J.latest_of_stream(stream, ["k"], ["event_id"], "audit")


@query("SELECT event_type, day, fetched, previous, coalesce(fetched >= previous * 0.5, true) AS may_close FROM (SELECT *, lag(fetched) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched FROM events GROUP BY 1, 2))")
def volume_floor_gate(spark, d):
    """FLT-19, DML-04, STM-04, STM-07."""
    runs = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("fetched"))
    return J.gate_runs(runs, "event_type", "day", "fetched").select("event_type", "day", "fetched", "previous", "may_close")


@query("""WITH e AS (SELECT user_id, epoch_ms(ts) AS t, event_type FROM events), w AS (SELECT max(t) - 86400000 AS w FROM e),
a AS (SELECT user_id, max(t) AS seen, CASE WHEN arg_max(event_type, t) = 'purchase' THEN max(t) ELSE min(t) END AS posted FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN posted + 864000000 < seen THEN seen WHEN posted + 864000000 <= w THEN posted + 864000000 END AS closed_ms FROM a, w""")
def stream_ageing(spark, d):
    """DML-05, STM-04, STM-05: what was posted over ten days ago closes by a timer, and opens when it is seen; a purchase says anew when it was posted."""
    stream = _stream(spark, d).select("user_id", F.col("ts").alias("seen"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("posted"))
    log = ageing(stream, "user_id", "seen", "posted", days=10)
    state = J.latest_of_stream(log, ["user_id"], ["at", "step"], "ageing")
    return state.select("user_id", F.when(F.col("change") == "close", F.unix_millis("at")).alias("closed_ms"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || ' in full' ELSE o_orderstatus END AS description, CASE WHEN o_orderkey % 8 = 0 THEN 'https://x.example/' || o_custkey ELSE 'https://x.example/list' END AS url FROM orders")
def changed_detail(spark, d):
    """STM-12, SRC-05: details are merged for changed rows only."""
    from ..sources.providers import merge_details

    key = F.col("o_orderkey").alias("external_id")
    listed = table(spark, d, "orders").select(key, F.col("o_orderstatus").alias("description"), F.lit("https://x.example/list").alias("url"))
    address = F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit("https://x.example/"), F.col("o_custkey").cast("string")))
    details = table(spark, d, "orders").select(key, F.concat("o_orderpriority", F.lit(" in full")).alias("description"), address.alias("url"))
    return merge_details(listed, details, listed.where("external_id % 4 = 0")).select(F.col("external_id").alias("o_orderkey"), "description", "url")


@query("SELECT o_orderkey, again AS asked_again, CASE WHEN again AND o_orderkey % 5 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS met, CASE WHEN again AND o_orderkey % 5 <> 0 THEN '' WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS missing FROM (SELECT *, o_orderkey % 6 = 0 AS again FROM orders)")
def bounded_reask(spark, d):
    """STM-11: an answer that met nothing and missed something is asked again once; the second answer is believed."""
    none = F.array().cast("array<string>")
    o = table(spark, d, "orders")
    first = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, none).otherwise(F.array("o_orderstatus")).alias("met"), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(none).alias("missing"))
    second = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.array("o_orderpriority").alias("met"), none.alias("missing"))
    return J.reasked(first, second, "o_orderkey").select("o_orderkey", "asked_again", F.array_join("met", ",").alias("met"), F.array_join("missing", ",").alias("missing"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    """Extension: tumbling event-time windows."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.windowed_counts(e, "ts", "6 hours", by=("event_type",)).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY 1")
def ext_sliding(spark, d):
    """Extension: sliding windows of six hours every three."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.windowed_counts(e, "ts", "6 hours", "3 hours").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY user_id")
def ext_session(spark, d):
    """Extension: session windows."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return J.session_counts(e, "ts", "2 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT user_id, event_type AS type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2")
def audit_append(spark, d):
    """SNK-01, STM-06: two runs append to the audit log, which is then read back."""
    path = shared_path(spark, "audit")
    e = table(spark, d, "events").withColumns({"type": F.col("event_type"), "payload_json": F.to_json(F.struct("event_id", "props")), "created_at": F.col("ts")})
    for run in (0, 1):
        append_events(e.where(F.col("event_id") % 2 == run), path)
    return read_events(spark, path).groupBy("user_id", "type").agg(F.count("*").alias("n"), F.max(F.get_json_object("payload_json", "$.event_id").cast("bigint")).alias("last"))


# ---- feeds into state: three runs over orders as postings, of which each misses some ----

_POSTING = "source string, external_id string, price double, raw_json string"


def _run(spark, d, r):
    """What run ``r`` delivers: a seventh of the orders is missing; of the lowest priority nearly all is, in run 1; some have changed."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    there = (k % 7 != r) & ((F.col("o_orderpriority") != "5-LOW") | (k % 10 == 0) if r == 1 else F.lit(True))
    value = F.when((k % 5 == r) & (F.lit(r) > 0), r).otherwise(0)
    return o.where(there).select(F.col("o_orderpriority").alias("source"), k.cast("string").alias("external_id"), (F.col("o_totalprice") + value).alias("price"),
                                 F.to_json(F.struct(value.alias("v"))).alias("raw_json"), (F.lit(RUN) + F.expr(f"INTERVAL {r} DAYS")).alias("fetched_at"))


def _ingested(spark, d):
    """The state after three runs, each of which a stream takes up as it comes."""
    folder = shared_path(spark, "ingest")
    ingest = Ingest(spark, f"{folder}/state", _POSTING, rows=1 << 18)
    for r in range(3):
        _run(spark, d, r).write.mode("append").parquet(f"{folder}/in")
        ingest.run(spark.readStream.schema(f"{_POSTING}, fetched_at timestamp").parquet(f"{folder}/in"), f"{folder}/offsets")
    return ingest


def _ingest_sql() -> str:
    """What is delivered, whether it may close, and the state, run by run."""
    steps = []
    for r in range(3):
        there = f"o_orderkey % 7 <> {r}" + (" AND (o_orderpriority <> '5-LOW' OR o_orderkey % 10 = 0)" if r == 1 else "")
        steps.append(f"i{r} AS (SELECT o_orderkey AS k, o_orderpriority AS source, CASE WHEN o_orderkey % 5 = {r} AND {r} > 0 THEN {r} ELSE 0 END AS v, o_totalprice AS p FROM orders WHERE {there})")
        before = f"LEFT JOIN g{r - 1} AS b ON b.source = a.source" if r else ""
        steps.append(f"g{r} AS (SELECT a.source, a.n, {'coalesce(a.n >= b.n * 0.5, true)' if r else 'true'} AS may FROM (SELECT source, count(*) AS n FROM i{r} GROUP BY 1) AS a {before})")
        if not r:
            steps.append("s0 AS (SELECT k, source, v, p + v AS price, 0 AS created, 0 AS updated, NULL::INT AS closed, 'insert' AS op FROM i0)")
            continue
        op = "CASE WHEN s.k IS NULL THEN 'insert' WHEN i.k IS NULL AND s.closed IS NULL AND g.may THEN 'close' WHEN i.k IS NOT NULL AND (i.v <> s.v OR s.closed IS NOT NULL) THEN 'update' ELSE 'unchanged' END"
        steps.append(f"j{r} AS (SELECT coalesce(s.k, i.k) AS k, coalesce(s.source, i.source) AS source, s.v AS v0, s.price AS price0, s.created AS created0, s.updated AS updated0, s.closed AS closed0, i.v AS v1, i.p + i.v AS price1, {op} AS op "
                     f"FROM s{r - 1} AS s FULL JOIN i{r} AS i ON i.k = s.k LEFT JOIN g{r} AS g ON g.source = coalesce(s.source, i.source))")
        new = "op IN ('insert', 'update')"
        steps.append(f"s{r} AS (SELECT k, source, CASE WHEN {new} THEN v1 ELSE v0 END AS v, CASE WHEN {new} THEN price1 ELSE price0 END AS price, coalesce(created0, {r}) AS created, CASE WHEN {new} THEN {r} ELSE updated0 END AS updated, "
                     f"CASE WHEN op = 'close' THEN {r} WHEN {new} THEN NULL ELSE closed0 END AS closed, op FROM j{r})")
    return "WITH " + ",\n".join(steps)


_DAYS = lambda c: F.datediff(c, F.lit(RUN))


@query(f"{_ingest_sql()} SELECT k, source, round(price, 2) AS price, created, updated, closed FROM s2")
def stream_ingest_state(spark, d):
    """STM-02, DML-01, DML-02, DML-04, STM-05, FLT-19: diffs and closings of three runs of a stream; a source that delivers much less closes nothing."""
    return _ingested(spark, d).read().select(F.col("external_id").cast("bigint").alias("k"), "source", F.round("price", 2).alias("price"),
                                             _DAYS("created_at").alias("created"), _DAYS("updated_at").alias("updated"), _DAYS("closed_at").alias("closed"))


@query(_ingest_sql() + " " + " UNION ALL ".join(
    f"SELECT {r} AS run, g.source, g.n AS fetched, g.may AS may_close, count(*) FILTER (WHERE s.op = 'insert') AS inserted, count(*) FILTER (WHERE s.op = 'update') AS updated, count(*) FILTER (WHERE s.op = 'close') AS closed FROM g{r} AS g JOIN s{r} AS s ON s.source = g.source GROUP BY ALL" for r in range(3)))
def stream_ingest_audit(spark, d):
    """SNK-01, STM-07, STM-08: one audit row a run and source, of the same versions as the state."""
    counts = "fetched bigint, may_close boolean, inserted bigint, updated bigint, closed bigint"
    events = _ingested(spark, d).read("audit").select(_DAYS("created_at").alias("run"), F.from_json("payload_json", f"source string, {counts}").alias("p"))
    return events.select("run", "p.source", "p.fetched", "p.may_close", "p.inserted", "p.updated", "p.closed")


@query(_ingest_sql() + """ SELECT s2.k, CASE WHEN s0.k IS NULL THEN 'insert' WHEN s0.closed IS NULL AND s2.closed IS NOT NULL THEN 'close' ELSE 'update' END AS change
FROM s2 LEFT JOIN s0 USING (k) WHERE s0.k IS NULL OR s0.updated <> s2.updated OR s0.closed IS DISTINCT FROM s2.closed""")
def stream_change_feed(spark, d):
    """STM-12: what became of the postings from the first version to the last, from the parts that differ."""
    ingest = _ingested(spark, d)
    return ingest.changes(ingest.store.versions()[0]).select(F.col("external_id").cast("bigint").alias("k"), F.col("_change").alias("change"))


def _provider(prompts: list[str], attempt: int) -> list[tuple[str, int]]:
    """Stands for a model: what it meets and misses of a prompt ``key:status:priority``."""
    out = []
    for p in prompts:
        key, status, priority = p.split(":")
        met = [] if int(key) % 3 == 0 and (attempt == 0 or int(key) % 5 == 0) else [status]
        out.append((json.dumps({"met": met, "missing": [priority] if int(key) % 2 == 0 else []}), len(p)))
    return out


def _met_nothing(answer: str) -> bool:
    found = json.loads(answer)
    return not found["met"] and bool(found["missing"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 2 = 1 OR o_orderkey % 5 = 0) THEN NULL ELSE o_orderstatus END AS met, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS attempts,
(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus) + length(o_orderpriority) + 2) * CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS tokens FROM orders""")
def asked_with_ledger(spark, d):
    """SRC-21, STM-09, STM-11, VAL-08, AGG-05: a provider is asked once for each key, and once more where it met nothing; the ledger keeps what was paid for."""
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("prompt"))
    found = ask_all(prompts, _provider, shared_path(spark, "ledger"), _met_nothing, buckets=16, call=256)
    return found.select(F.col("key").cast("bigint").alias("o_orderkey"), F.get(F.from_json("answer", "met array<string>")["met"], F.lit(0)).alias("met"), "attempts", "tokens")
