"""Versions of several tables: splits, merges, replays, removal; feeds into state."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postmill.schemas import schema
from postmill.streaming import ingest as I
from postmill.streaming.store import Store, Table

ROW = "k bigint, v bigint"


def _latest(old, new):
    return old.unionByName(new.select(*old.columns)).groupBy("k").agg(F.max("v").alias("v"))


def _store(spark, folder, **more):
    return Store(spark, str(folder), {"t": Table(schema(ROW), ("k",), **more), "log": Table(schema(ROW))})


def _put(spark, store, number, rows):
    version = store.begin(number)
    if version is None:
        return None
    df = spark.createDataFrame(rows, ROW)
    store.merge(version, "t", df, _latest)
    store.append(version, "log", df)
    store.commit(version)
    return version


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parts_split_as_they_grow_and_give_the_same_rows(spark, tmp_path):
    small, large = _store(spark, tmp_path / "a", rows=8), _store(spark, tmp_path / "b", parts=4)
    for number, rows in enumerate([[(k, 0) for k in range(40)], [(k, 1) for k in range(30, 300)], [(7, 2), (None, 3)]]):
        for s in (small, large):
            _put(spark, s, number, rows)
    assert _rows(small.read("t")) == _rows(large.read("t")) and small.read("t").count() == 301
    parts = small.parts("t")
    assert len(parts) > 30 > len(large.parts("t")) == 4 and max(p.rows for p in parts) <= 16
    assert parts[0].start == 0 and parts[-1].end == 1 << 31 and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    assert sum(p.version == 2 for p in parts) <= 4  # two keys: their parts, and what they were split into


def test_a_table_that_was_emptied_keeps_its_ranges(spark, tmp_path):
    store = _store(spark, tmp_path, parts=2)
    _put(spark, store, 0, [(1, 1), (2, 1), (3, 1)])
    version = store.begin(1)
    store.merge(version, "t", spark.createDataFrame([(1, 0), (2, 0), (3, 0)], ROW), lambda old, new: old.join(new, "k", "left_anti").select("k", "v"))
    store.commit(version)
    assert store.read("t").count() == 0
    _put(spark, store, 2, [(5, 5)])
    assert _rows(store.read("t")) == [(5, 5)] and store.read("t", 0).count() == 3


def test_versions_come_whole_and_once(spark, tmp_path):
    store = _store(spark, tmp_path)
    _put(spark, store, 0, [(1, 1)])
    dead = store.begin(1)
    store.merge(dead, "t", spark.createDataFrame([(1, 9), (2, 9)], ROW), _latest)
    store.append(dead, "log", spark.createDataFrame([(1, 9)], ROW))
    assert _rows(store.read("t")) == _rows(store.read("log")) == [(1, 1)]  # not committed
    _put(spark, _store(spark, tmp_path), 1, [(1, 5)])
    assert _rows(store.read("t")) == [(1, 5)] and _rows(store.read("log")) == [(1, 1), (1, 5)]
    assert store.begin(1) is None and store.begin(0) is None
    with pytest.raises(ValueError, match="no version 7"):
        store.read("t", 7)


def test_files_stay_bounded(spark, tmp_path):
    store = _store(spark, tmp_path, parts=2)
    for number in range(40):
        _put(spark, store, number, [(number % 5, number)])
        store.vacuum()
    assert store.versions() == [38, 39] and _rows(store.read("t")) == [(k, 35 + k) for k in range(5)]
    assert store.read("log").count() == 40 and len(store.parts("log")) <= 17
    assert _rows(store.read("t", 38)) == [*[(k, 35 + k) for k in range(4)], (4, 34)]
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) < 200
    assert store.vacuum() == 0


def test_changes_between_versions_read_parts_that_differ(spark, tmp_path):
    schema_ = schema("k bigint, v bigint, closed bigint")
    store = Store(spark, str(tmp_path), {"t": Table(schema_, ("k",), parts=8)})

    def put(number, rows, gone=()):
        version = store.begin(number)
        new = spark.createDataFrame([*rows, *((k, None, -1) for k in gone)], schema_)
        store.merge(version, "t", new, lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new.where("NOT closed <=> -1")).select("k", "v", "closed"))
        store.commit(version)

    put(0, [(k, 0, None) for k in range(50)] + [(90, 0, 5)])
    put(1, [(1, 1, None), (2, 0, 7), (60, 0, None), (90, 0, None)], gone=[3])
    put(2, [(4, 0, None)])
    of = lambda df: {r["k"]: r["_change"] for r in df.collect()}
    assert of(store.changes("t", 0, 1, "closed")) == {1: "update", 2: "close", 3: "delete", 60: "insert", 90: "reopen"} == of(store.changes("t", 0, None, "closed"))
    assert of(store.changes("t", 1, 2)) == {} and len(of(store.changes("t", None, 2))) == 51
    files = store.changes("t", 1, 2).inputFiles()
    assert len({f.rsplit("part=", 1)[1].split("/")[0] for f in files}) == 1  # of eight


POSTING = "source string, external_id string, title string, raw_json string"


def _fetch(spark, folder, day, rows):
    rows = [(s, e, f"t{v}", json.dumps({"v": v})) for s, e, v in rows]
    spark.createDataFrame(rows, POSTING).withColumn("fetched_at", F.expr(f"TIMESTAMP '2024-01-01' + INTERVAL {day} DAYS")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _take(spark, folder, make, fail=False, **more):
    ingest = make(spark, f"{folder}/state", POSTING, **more)
    stream = spark.readStream.schema(f"{POSTING}, fetched_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    if fail:
        def die(version):
            raise RuntimeError("killed")

        ingest.store.commit = die
    ingest.run(stream, f"{folder}/offsets")
    return ingest


def _state(ingest):
    return sorted((r["source"], r["external_id"], r["title"], r["created_at"].day, r["updated_at"].day, r["closed_at"] and r["closed_at"].day) for r in ingest.read().collect())


def _audit(ingest):
    return [(p["source"], p["fetched"], p["inserted"], p["updated"], p["closed"], p["may_close"]) for p in (json.loads(r["payload_json"]) for r in ingest.read("audit").orderBy("created_at", "payload_json").collect())]


def test_a_feed_into_state_survives_its_death(spark, tmp_path):
    _fetch(spark, tmp_path, 0, [("a", "1", 0), ("a", "2", 0), ("a", "2", 1), ("b", "1", 0)])
    first = _take(spark, tmp_path, I.Ingest)
    assert _audit(first) == [("a", 2, 2, 0, 0, True), ("b", 1, 1, 0, 0, True)]
    _fetch(spark, tmp_path, 1, [("a", "1", 0), ("a", "3", 0)])
    with pytest.raises(Exception, match="killed"):
        _take(spark, tmp_path, I.Ingest, fail=True)
    assert _state(first) == _state(I.Ingest(spark, f"{tmp_path}/state", POSTING)) and len(_audit(first)) == 2
    again = _take(spark, tmp_path, I.Ingest)
    assert _audit(again)[2:] == [("a", 2, 1, 0, 1, True)]  # once, though the batch came twice
    assert _state(again) == [("a", "1", "t0", 1, 1, None), ("a", "2", "t1", 1, 1, 2), ("a", "3", "t0", 2, 2, None), ("b", "1", "t0", 1, 1, None)]
    _fetch(spark, tmp_path, 2, [("a", "2", 1), ("b", "9", 0)])  # an equal payload reopens; b/1 closes
    third = _take(spark, tmp_path, I.Ingest)
    assert ("a", "2", "t1", 1, 3, None) in _state(third) and ("b", "1", "t0", 1, 1, 3) in _state(third) and ("a", "1", "t0", 1, 1, 3) in _state(third)
    assert {(r["source"], r["external_id"]): r["_change"] for r in third.changes(1).collect()} == {("a", "1"): "close", ("a", "2"): "reopen", ("a", "3"): "close", ("b", "1"): "close", ("b", "9"): "insert"}
    assert {r["source"]: (r["fetched"], r["runs"]) for r in third.read("counters").collect()} == {"a": (1, 3), "b": (1, 2)}


def test_only_complete_sources_with_volume_close(spark, tmp_path):
    _fetch(spark, tmp_path, 0, [("a", str(k), 0) for k in range(6)] + [("part", "1", 0)])
    _fetch(spark, tmp_path, 1, [("a", "0", 0), ("part", "2", 0)])
    got = _take(spark, tmp_path, I.Ingest, complete=F.col("source") != "part")
    assert all(closed is None for *_, closed in _state(got)) and ("a", 1, 0, 0, 0, False) in _audit(got) and ("part", 1, 1, 0, 0, False) in _audit(got)


def test_a_batch_reads_the_state_in_one_join_and_closes_in_parts_it_has_no_key_of(spark, tmp_path, monkeypatch):
    """The state meets the batch once, for changes and closings alike; parts without a key of the batch are written anew only if they have rows to close."""
    merges, merge = [], Store.merge

    def noted(self, version, table, changes, apply, also=None):
        def applied(old, new):
            out = apply(old, new)
            merges.append((table, out._jdf.queryExecution().optimizedPlan().toString().count("FullOuter"), changes.columns))
            return out

        return merge(self, version, table, changes, applied, also)

    monkeypatch.setattr(Store, "merge", noted)
    _fetch(spark, tmp_path, 0, [("a", str(k), 0) for k in range(40)] + [("b", str(k), 0) for k in range(40)])
    first = _take(spark, tmp_path, I.Ingest, parts=16, floor=0.0)
    _fetch(spark, tmp_path, 1, [("a", "1", 0), ("a", "2", 7)])
    _take(spark, tmp_path, I.Ingest, parts=16, floor=0.0)
    _fetch(spark, tmp_path, 2, [("a", "1", 0)])
    got = _take(spark, tmp_path, I.Ingest, parts=16, floor=0.0)
    want = [("a", str(k), "t7" if k == 2 else "t0", 1, 2 if k == 2 else 1, None if k == 1 else 3 if k == 2 else 2) for k in range(40)] + [("b", str(k), "t0", 1, 1, None) for k in range(40)]
    assert _state(got) == sorted(want) and len(first.store.parts("postings")) == 16
    assert sum(p.version == 2 for p in got.store.parts("postings")) <= 2  # those of a/1 and a/2
    assert all(joins == 1 and "__gone" not in columns for table, joins, columns in merges if table == "postings")
