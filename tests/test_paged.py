"""Recorded listings: where reading stops, ranges, and a stream that goes on from where it was."""

import json
import os

from pyspark.sql import functions as F

from postmill.sources import paged
from postmill.streaming import jobs


def _record(folder, source, page, records, **more):
    where = f"{folder}/source={source}/page={page}"
    os.makedirs(where)
    with open(f"{where}/p.json", "w") as f:
        f.write(records if isinstance(records, str) else json.dumps({"content": records, **more}))


def _got(df):
    return sorted((r["source"], r["page"]) for r in df.collect())


def test_pages_after_the_stop_are_not_opened(spark, tmp_path):
    """A page that can't be parsed stands after every stop: reading it would be an error."""
    for page in range(2):
        _record(tmp_path, "empty", page, [1, 2])
        _record(tmp_path, "refused", page, [1, 2])
        _record(tmp_path, "total", page, [1, 2], totalFound=4)
        _record(tmp_path, "most", page, [1, 2])
    _record(tmp_path, "empty", 2, [])
    os.makedirs(f"{tmp_path}/source=refused/page=2")
    open(f"{tmp_path}/source=refused/page=2/_refused", "w").close()
    _record(tmp_path, "most", 2, [1])
    for source in ("empty", "refused", "total", "most"):
        _record(tmp_path, source, 2 if source == "total" else 3, "broken{")
    got = paged.read_pages(spark, str(tmp_path), "content", "totalFound", size=2, most=6)
    assert _got(got) == [(s, p) for s in ("empty", "most", "refused", "total") for p in range(3 if s == "most" else 2)]


def test_known_totals_are_read_in_ranges(spark, tmp_path):
    for page in range(7):
        _record(tmp_path, "a", page, [1, 2])
    _record(tmp_path, "b", 0, [1])
    got = paged.read_pages(spark, str(tmp_path), "content", totals={"a": 11, "b": None}, size=2, range_pages=2)
    assert got.rdd.getNumPartitions() == 4 and _got(got) == [("a", p) for p in range(6)] + [("b", 0)]


def test_bare_lists(spark, tmp_path):
    _record(tmp_path, "a", 0, "[1, 2]")
    _record(tmp_path, "a", 1, "[]")
    assert [r["payload"] for r in paged.read_pages(spark, str(tmp_path)).collect()] == ["[1, 2]"]


def test_a_stream_goes_on_from_its_offsets(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []

    def run():
        seen.clear()
        stream = paged.read_pages(spark, folder, "content", stream=True, size=2)
        jobs.run_available(stream, lambda batch, number: seen.extend((r["source"], r["page"]) for r in batch.collect()), f"{tmp_path}/offsets")
        return sorted(seen)

    _record(folder, "a", 0, [1, 2])
    _record(folder, "b", 0, [1, 2])
    assert run() == [("a", 0), ("b", 0)]
    _record(folder, "a", 1, [1])
    _record(folder, "c", 0, [1])
    assert run() == [("a", 1), ("c", 0)]
    assert run() == []


def test_pages_in_bundles(spark, tmp_path):
    """Stops within a bundle and between two, pages after a stop that can't be parsed, and a stream that takes what a bundle grew by."""
    def lines(source, k, *pages):
        os.makedirs(where := f"{tmp_path}/in/source={source}/pages={k}", exist_ok=True)
        with open(f"{where}/{len(os.listdir(where))}.txt", "w") as f:
            f.writelines(f"{n}\t{p if isinstance(p, str) else json.dumps({'content': p, 'totalFound': 99})}\n" for n, p in pages)

    lines("a", 0, (1, [1, 2]), (2, [3, 4]), (0, [0]))
    lines("a", 1, (3, [5]), (4, []), (5, "broken{"))
    lines("b", 0, (0, [1, 2]), (2, "broken{"))
    read = lambda **more: paged.read_pages(spark, f"{tmp_path}/in", "content", "totalFound", size=2, bundle=3, **more)
    assert _got(read()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)] and _got(read(most=4)) == [("a", 0), ("a", 1), ("b", 0)]
    assert _got(read(totals={"a": 7}, range_pages=2)) == [("a", n) for n in range(4)]
    seen = []
    lines("c", 0, (0, [1]))
    for want in ([("c", 0)], [("c", 1), ("c", 2), ("c", 3)]):
        seen.clear()
        jobs.run_available(read(stream=True, totals={"c": None}), lambda batch, number: seen.extend(_got(batch)), f"{tmp_path}/offsets")
        assert sorted(seen) == want
        lines("c", 0, (1, [2]), (2, [3]))
        lines("c", 1, (3, [4]))


def test_files_of_the_query_are_bundles(spark):
    """Not a file for each four customers."""
    from pyspark.sql import DataFrameWriter

    from postmill.plans import QUERIES

    from .conftest import SMALL

    written, real = [], DataFrameWriter.text
    try:
        DataFrameWriter.text = lambda self, path, *more, **options: (written.append(path.removeprefix("file:").replace("//", "/")), real(self, path, *more, **options))[1]
        QUERIES["paged_source"](spark, SMALL)
    finally:
        DataFrameWriter.text = real
    assert sum(n.endswith(".txt") for _, _, names in os.walk(written[0]) for n in names) <= 25


def test_no_listing(spark, tmp_path):
    got = paged.read_pages(spark, str(tmp_path), totals={"none": None})
    assert got.count() == 0 and got.select(F.col("page")).schema.simpleString() == "struct<page:int>"
