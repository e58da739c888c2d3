"""Merges, duplicates and streams: idempotent, and exact about what changes."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from postmill import schemas
from postmill.operators import dedupe, merge, readmodel, registry
from postmill.session import remove_leftovers, shared_path
from postmill.sources import office, payloads, providers
from postmill.streaming import jobs

RUN = dt.datetime(2024, 6, 1)
DDL = "source string, external_id string, title string, raw_json string, created_at timestamp, updated_at timestamp, closed_at timestamp, dedupe_key string"


def test_a_second_merge_changes_nothing(spark):
    old = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([("s", "1", "a", '{"x":1}', old, old, None, "k"), ("s", "2", "b", '{"x":2}', old, old, old, "k"), ("s", "3", "c", '{"x":3}', old, old, None, "k"), ("s", "9", "z", "{}", old, old, None, "k")], DDL)
    batch = spark.createDataFrame([("s", "1", "a", '{ "x": 1 }'), ("s", "2", "b", '{"x":2}'), ("s", "3", "C", '{"x":4}'), ("s", "4", "d", '{"x":5}')], "source string, external_id string, title string, raw_json string")
    go = lambda c: merge.diff_upsert(c, batch, ["source", "external_id"], ["title", "raw_json"], "raw_json", RUN)
    first = {r["external_id"]: r for r in go(current).collect()}
    assert {k: r["_op"] for k, r in first.items()} == {"1": "unchanged", "2": "update", "3": "update", "4": "insert", "9": "unchanged"}
    assert first["2"]["closed_at"] is None and first["2"]["dedupe_key"] is None and first["2"]["created_at"] == old and first["3"]["title"] == "C" and first["1"]["dedupe_key"] == "k"
    assert {r["_op"] for r in go(go(current).drop("_op")).collect()} == {"unchanged"}


def test_an_empty_fetch_closes_nothing(spark):
    current = spark.createDataFrame([("1", None), ("2", None)], "k string, closed_at timestamp")
    none = spark.createDataFrame([], "k string")
    assert merge.close_missing(current, none, ["k"], F.lit(True), RUN).where("closed_at IS NOT NULL").count() == 0
    assert [r["k"] for r in merge.close_missing(current, spark.createDataFrame([("1",)], "k string"), ["k"], F.lit(True), RUN).where("closed_at IS NOT NULL").collect()] == ["2"]


def test_cas_moves_once(spark):
    rows = spark.createDataFrame([(1, "queued"), (2, "applied")], "id int, status string")
    once = merge.compare_and_set(rows, "status", {"queued": "approved"})
    assert {r["id"]: (r["status"], r["affected"]) for r in once.collect()} == {1: ("approved", True), 2: ("applied", False)}
    assert merge.compare_and_set(once.drop("affected"), "status", {"queued": "approved"}).where("affected").count() == 0


def test_duplicates_across_sources_only(spark):
    jobs_ = spark.createDataFrame([(1, "jobspy:indeed", "Acme", "Sr. Engineer", "San Francisco, California, United States", None, None, None), (2, "greenhouse", "Acme Inc", "Senior Engineer", "San Francisco, CA", None, None, None), (3, "greenhouse", "Acme Inc", "Senior Engineer", "San Francisco", None, None, None)],
                                  "id bigint, source string, company string, title string, location string, closed_at timestamp, dedupe_key string, canonical_id bigint")
    done = dedupe.assign_canonical(dedupe.fill_keys(jobs_))
    assert {r["id"]: r["canonical_id"] for r in done.collect()} == {1: 2, 2: None, 3: None}
    again = dedupe.assign_canonical(done.drop("change"))
    assert again.where("change <> 'none'").count() == 0


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 50), (1, 101), (2, None)], "id int, score int")
    bad = {r["check"]: r["n"] for r in schemas.violations(rows, {"score": F.coalesce(F.col("score").between(0, 100), F.lit(True))}, ["id"]).collect()}
    assert bad == {"score": 1, "unique(id)": 1}


STATE = "user bigint, v bigint, at bigint"


def _arrivals(spark, data, users, v):
    spark.createDataFrame([(k, v, v * 10 + k) for k in users], STATE).coalesce(1).write.mode("append").parquet(data)


def test_a_new_object_goes_on_from_the_folder(spark, tmp_path):
    data, state, offsets = (str(tmp_path / x) for x in ("in", "state", "offsets"))

    def run():
        stream = spark.readStream.schema(STATE).option("maxFilesPerTrigger", 1).parquet(data)
        snap, seen = jobs.Snapshot(spark, state, stream.schema, ["user"], parts=8), []
        merge_ = jobs.merge_latest(snap, ["at"])
        jobs.run_available(stream, lambda batch, number: (seen.append(number), merge_(batch, number)), offsets)
        return seen, sorted((r["user"], r["v"]) for r in snap.read().collect())

    _arrivals(spark, data, [0, 1, 2], 1)
    _arrivals(spark, data, [1, 3], 2)
    seen, rows = run()
    assert len(seen) == 2 and rows == [(0, 1), (1, 2), (2, 1), (3, 2)]
    _arrivals(spark, data, [5], 3)
    seen, rows = run()
    assert seen == [2] and rows == [(0, 1), (1, 2), (2, 1), (3, 2), (5, 3)]
    assert run() == ([], rows)


def test_a_periodic_run_takes_what_has_come(spark, tmp_path):
    data = str(tmp_path / "in")
    _arrivals(spark, data, [0, 1], 1)
    stream = spark.readStream.schema(STATE).parquet(data)
    snap = jobs.Snapshot(spark, str(tmp_path / "state"), stream.schema, ["user"], parts=4)
    run = jobs.run_every(stream, jobs.merge_latest(snap, ["at"]), str(tmp_path / "offsets"), "1 second")
    run.processAllAvailable()
    _arrivals(spark, data, [1], 2)
    run.processAllAvailable()
    run.stop()
    assert sorted((r["user"], r["v"]) for r in snap.read().collect()) == [(0, 1), (1, 2)]


def test_a_replayed_batch_changes_nothing_and_others_parts_stay(spark, tmp_path):
    schema = spark.createDataFrame([], STATE).schema
    snap = jobs.Snapshot(spark, str(tmp_path / "state"), schema, ["user"], parts=16)
    merge_ = jobs.merge_latest(snap, ["at"])
    batch = lambda users, v: spark.createDataFrame([(k, v, v * 10 + k) for k in users], STATE)
    merge_(batch(range(40), 1), 0)
    merge_(batch([7], 2), 1)
    once = sorted(map(tuple, snap.read().collect()))
    assert (7, 2, 27) in once and len(once) == 40
    assert set(snap.holders().values()) == {0, 1} and list(snap.holders().values()).count(1) == 1  # one part was written anew
    merge_(batch([7], 2), 1)
    assert sorted(map(tuple, jobs.Snapshot(spark, str(tmp_path / "state"), schema, ["user"], parts=16).read().collect())) == once
    # a version whose list was never finished does not count
    (tmp_path / "state" / "lists" / "9").mkdir()
    assert snap.versions() == [0, 1]


def test_late_and_empty_batches_keep_the_state(spark, tmp_path):
    schema = spark.createDataFrame([], STATE).schema
    snap = jobs.Snapshot(spark, str(tmp_path / "state"), schema, ["user"], parts=4)
    assert snap.read().count() == 0
    merge_ = jobs.merge_latest(snap, ["at"])
    merge_(spark.createDataFrame([(1, 5, 50)], STATE), 0)
    merge_(spark.createDataFrame([(1, 4, 40)], STATE), 1)
    merge_(spark.createDataFrame([], STATE), 2)
    assert [tuple(r) for r in snap.read().collect()] == [(1, 5, 50)]


def test_malformed_payloads_do_not_stop_a_merge(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b":2,"a":1}'), ("{broken", "{broken"), ("{broken", "{}"), (None, "x")], "a string, b string")
    assert [r["s"] for r in rows.select(merge.canonical_json(F.col("a")).eqNullSafe(merge.canonical_json(F.col("b"))).alias("s")).collect()] == [True, True, False, False]


def test_shallow_merge(spark):
    rows = spark.createDataFrame([('{"a": {"x": 1}, "b": [1]}', '{"a": {"y": 2.5}}'), ("{}", '{"k": null}'), (None, '{"k": "v"}'), ('{"k": 1}', "nope")], "l string, r string")
    assert [json.loads(r["m"]) for r in rows.select(merge.shallow_merge(F.col("l"), F.col("r")).alias("m")).collect()] == [{"a": {"y": 2.5}, "b": [1]}, {"k": None}, {"k": "v"}, {"k": 1}]


def test_the_audit_log_only_grows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "feed.done", "{}", RUN), (3, "match.scored", '{"score": 5}', RUN)], "user_id bigint, type string, payload_json string, created_at timestamp")
    for _ in range(2):
        readmodel.append_events(rows.withColumn("more", F.lit(1)), str(tmp_path / "log"))
    log = readmodel.read_events(spark, str(tmp_path / "log"))
    assert log.count() == 4 and log.columns == rows.columns


def test_a_cursor_walks_the_same_pages_as_offsets(spark):
    """Ties of all kinds, and unjudged rows at the end."""
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 2, k % 4) for k in range(40)], "id int, score int, created int")
    last, walked = None, []
    while page := readmodel.page_after(rows, "score", "created", "id", 7, last).collect():
        walked += [r["id"] for r in page]
        last = page[-1]
    assert walked == [r["id"] for r in readmodel.page(rows, "score", "created", "id", 100).collect()] and len(walked) == 40


def test_a_frozen_worksheet_is_never_overwritten(spark, tmp_path):
    rows = spark.range(2)
    payloads.write_frozen(rows, str(tmp_path / "w"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        payloads.write_frozen(rows, str(tmp_path / "w"))


def test_resumes_are_read_and_empty_ones_refused(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Jane")
    (tmp_path / "b.pdf").write_text("%PDF")
    assert [r["text"] for r in payloads.read_resumes(spark, str(tmp_path)).collect()] == ["# Jane"]
    (tmp_path / "c.txt").write_text("  ")
    with pytest.raises(Exception, match="empty résumé"):
        payloads.read_resumes(spark, str(tmp_path)).collect()


def _office_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.mark.parametrize("body, text", [
    ("<w:p><w:pPr><w:pStyle w:val='Title'/></w:pPr><w:r><w:t>Jane</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>One </w:t></w:r><w:hyperlink><w:r><w:t>two</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>", "# Jane\n\nOne two"),
    ("<w:p><w:pPr><w:outlineLvl w:val='2'/></w:pPr><w:r><w:t>Work</w:t></w:r></w:p>", "### Work"),
    ("<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>", "a\tb\nc"),
    ("".join(f"<w:p><w:pPr><w:numPr><w:ilvl w:val='{n}'/><w:numId w:val='3'/></w:numPr></w:pPr><w:r><w:t>i{n}</w:t></w:r></w:p>" for n in (0, 1)) + "<w:p><w:r><w:t>end</w:t></w:r></w:p>", "- i0\n  - i1\n\nend"),
    ("<w:sdt><w:sdtContent><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:sdtContent></w:sdt>", "| a\\|b |  |\n| --- | --- |\n| c d |  |"),
    ("<w:p><mc:AlternateContent><mc:Choice><w:r><w:t>once</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>once</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>", "once"),
])
def test_office_files_become_markdown(body, text):
    assert office._markdown(_office_file(body)) == text


def test_a_file_that_cannot_be_read_leaves_the_others(spark, tmp_path, monkeypatch):
    (tmp_path / "a.DOCX").write_bytes(_office_file("<w:p><w:r><w:t>Jane</w:t></w:r></w:p>"))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.docx").write_bytes(_office_file("<w:p>"))
    (tmp_path / "d.docx").write_bytes(_office_file(""))
    (tmp_path / "e.md").write_text("\n \n")
    (tmp_path / "f.txt").write_text("John")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["problem"]) for r in payloads.resume_files(spark, str(tmp_path)).collect()}
    assert got == {"a.DOCX": ("Jane", None), "b.docx": (None, "unreadable résumé (BadZipFile)"), "c.docx": (None, "unreadable résumé (ParseError)"), "d.docx": (None, "empty résumé"), "e.md": (None, "empty résumé"), "f.txt": ("John", None)}
    with pytest.raises(Exception, match="unreadable résumé"):
        payloads.read_resumes(spark, f"{tmp_path}/b.docx").collect()
    monkeypatch.setattr(office, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        office._markdown(_office_file("<w:p/>"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf())
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(), "t")


def test_leftovers_go_when_they_are_old(spark):
    path = shared_path(spark, "left")
    spark.range(3).write.parquet(path)
    remove_leftovers(spark, hours=1)
    assert spark.read.parquet(path).count() == 3
    assert remove_leftovers(spark, hours=-1) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_late_rows_are_dropped_by_the_watermark(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5),), (dt.datetime(2024, 1, 1, 0, 55),)], "ts timestamp")
    assert [r["n"] for r in jobs.windowed_counts(frame, "ts", "1 hour").collect()] == [2]


def test_board_payload(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"total": 1}, "jobs": [{"id": 5, "title": "Dev", "absolute_url": "u", "location": {"name": "Oslo"}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "first_published": "2024-01-01T00:00:00-05:00"}]}))
    raw = payloads.read_payloads(spark, str(tmp_path / "a.json")).withColumns({"company": F.lit("Acme"), "slug": F.lit("acme")})
    r = providers.normalize(raw, "greenhouse").first()
    assert (r["external_id"], r["company"], r["locations"], r["remote_mode"], r["description"], r["ats_type"]) == ("acme:5", "Acme", ["Oslo"], None, "Hi & bye", "greenhouse") and json.loads(r["raw_json"])["id"] == 5


def test_rss_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Dev: Ops</title><region>Anywhere</region><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><description>&lt;b&gt;x&lt;/b&gt;</description></item><item><title>Solo</title><state>CA</state><country>US</country><guid>g2</guid></item></channel></rss>")
    got = {r["external_id"]: r for r in providers.read_rss(spark, str(tmp_path / "f.xml")).collect()}
    assert (got["weworkremotely:g1"]["company"], got["weworkremotely:g1"]["title"], got["weworkremotely:g1"]["description"]) == ("Acme", "Dev: Ops", "x")
    assert got["weworkremotely:g2"]["location"] == "CA, US" and got["weworkremotely:g2"]["company"] == got["weworkremotely:g2"]["title"] == "Solo"


def test_pages_stop_at_the_first_empty_one(spark):
    rows = spark.createDataFrame([("a", 1, "[1]"), ("a", 2, "[]"), ("a", 3, "[2]"), ("b", 1, "[3]")], "source string, page int, payload string")
    assert sorted((r["source"], r["page"]) for r in payloads.pages(rows, None, "source", "page").collect()) == [("a", 1), ("b", 1)]


def test_registry_ladder(spark):
    rows = spark.createDataFrame([("https://jobs.lever.co/z", "x"), ("https://z.com", "see https://jobs.lever.co/q"), ("https://z.com", "x"), ("Zeta", "x")], "u string, p string")
    probed = F.struct(F.lit("ashby").alias("ats"), F.lit("zeta").alias("slug"))
    assert [(r["b"] and r["b"]["slug"]) for r in rows.select(registry.resolve(F.col("u"), F.col("p"), probed).alias("b")).collect()] == ["z", "q", None, "zeta"]
