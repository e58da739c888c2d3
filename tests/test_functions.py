"""Rules of the string, date and classifier functions, case by case."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, lookups, scores, text
from postmill.operators import bars, filters, validate


def one(spark, fn, *values, ddl=None):
    cols = [f"c{k}" for k in range(len(values))]
    frame = spark.createDataFrame([tuple(values)], ddl or ", ".join(f"{c} string" for c in cols))
    return frame.select(fn(*(F.col(c) for c in frame.columns)).alias("x")).first()["x"]


@pytest.mark.parametrize("name, key", [("Acme Inc", "acme"), ("Acme", "acme"), ("Société Générale S.A.", "societegenerale"), ("Limited", "limited"), ("Acme Widgets, LLC", "acmewidgets"), ("", ""), (None, ""), ("Co", "co"), ("A.B.C. GmbH", "abc")])
def test_company(spark, name, key):
    assert one(spark, text.normalize_company, name) == key


@pytest.mark.parametrize("title, key", [("Sr. Manager - 744123", "seniormanager"), ("Engineer (m/w/d)", "engineer"), ("R&D Lead (All Genders)", "randdlead"), ("Summer Internship 2026", "summerinternship2026"), ("Associate, #259", "associate259"), ("Dev (REQ-1234)", "dev"), ("Jr Mgr", "juniormanager")])
def test_title(spark, title, key):
    assert one(spark, text.normalize_title, title) == key


def test_dedupe_key(spark):
    assert one(spark, text.dedupe_key, "Acme Inc", "Sr. Engineer", "San Francisco, CA") == one(spark, text.dedupe_key, "Acme", "Senior Engineer", "San Francisco, California, United States") == "acme|seniorengineer|sanfrancisco"
    assert one(spark, text.dedupe_key, "", "Engineer", "X") is None and one(spark, text.dedupe_key, "Acme", "Eng", None) == "acme|eng|"


@pytest.mark.parametrize("value", ["Ünïcode ﬁne ①", "plain", "ŁÓDŹ", "ß", "", "áb"])
def test_squash_is_nfkd(spark, value):
    folded = unicodedata.normalize("NFKD", value.lower())
    assert one(spark, text.squash, value) == re.sub("[^a-z0-9]+", "", "".join(c for c in folded if not unicodedata.combining(c)))


@pytest.mark.parametrize("name", ["Škoda Auto a.s.", "Türkiye İş Bankası", "Győri Kft", "Česko s.r.o.", "ﬁnance ½", "Acme Inc."])
def test_keys_are_nfkd_for_all_letters(spark, name):
    folded = "".join(c for c in unicodedata.normalize("NFKD", name.lower().replace(".", "")) if not unicodedata.combining(c))
    tokens = [t for t in re.split("[^a-z0-9]+", folded) if t]
    tokens = tokens[:-1] if len(tokens) > 1 and tokens[-1] in lookups.LEGAL_SUFFIXES else tokens
    assert one(spark, text.normalize_company, name) == "".join(tokens)


@pytest.mark.parametrize("value, clean", [("Led it (E11) well.", "Led it well."), ("Did [E1, E2] that", "Did that"), ("E3 first , then E44 .", "first, then."), ("ΔE2 CO2", "ΔE2 CO2"), ("a\n\nb", "a\n\nb")])
def test_handles_are_stripped(spark, value, clean):
    assert one(spark, text.strip_handles, value) == clean


@pytest.mark.parametrize("text_, fault", [
    ("Reduced latency of billing services by 76%", None), ("Cut billing latency 77%", "the number 77 is not in the cited evidence"), ("Led Kubernetes billing", "'Kubernetes' does not appear in the cited evidence"),
    ("Used PostgreSQL at Acme Widgets as Engineer", None), ("Used Azure", "'Azure' does not appear in the cited evidence")])
def test_bullets_stay_within_their_claim(spark, text_, fault):
    claim = "Latency of billing services reduced by 76% on Postgres"
    own = validate.own_words(F.array(F.lit("Acme Widgets")), F.array(F.lit("Engineer")), F.lit(""), F.lit(""))
    evidence = spark.createDataFrame([("E1", claim, "bullet"), ("E2", "Python", "skill")], "handle string, text string, kind string")
    bullets = spark.createDataFrame([("E1", text_), ("E2", "Wrote Python"), ("E9", "x")], "handle string, text string")
    got = {r["handle"]: r["fault"] for r in validate.check_bullets(bullets, evidence, own=own).collect()}
    assert got == {"E1": fault, "E2": "cites E2, a skill claim; a bullet must cite a bullet", "E9": "cites E9, which is not in the vault"}


def test_letters_are_blocked_by_any_fault(spark):
    evidence = spark.createDataFrame([("a", "E1", "Built 3 APIs in Go"), ("a", "E2", "twelve services"), ("b", "E1", "Ran AWS")], "letter string, handle string, text string")
    rows = [("a", 0, "My APIs in Go (E1) served twelve teams", ["E1", "E2"]), ("a", 1, "Nine years of it", ["E1"]), ("b", 0, "AWS and Azure", ["E1"]), ("b", 1, "hello", ["E7", "E8"]), ("c", 0, "quiet prose", [])]
    got = {(r["letter"], r["place"]): (r["fault"], r["blocked"]) for r in validate.check_letters(spark.createDataFrame(rows, "letter string, place int, text string, evidence_ids array<string>"), evidence).collect()}
    assert got == {("a", 0): (None, True), ("a", 1): ("the number 'Nine' is not in the cited evidence", True), ("b", 0): ("'Azure' does not appear in the cited evidence", True), ("b", 1): ("cites E7, E8, which is not in the vault", True), ("c", 0): (None, False)}


@pytest.mark.parametrize("term, hay, hit", [("go", "we go now", True), ("go", "good Google", False), ("C++", "c++ and", True), ("C++", "xc++", False), (".NET", "asp.net", True), ("node.js", "NODE.JS!", True), ("die", "die_x", False), ("é", "café é", True)])
def test_whole_words(spark, term, hay, hit):
    assert one(spark, lambda c: c.rlike(text.word_pattern(term)), hay) is hit


def test_html(spark):
    assert one(spark, text.html_to_text, "<p>a &amp; b</p><script>no</script><ul><li>x</li></ul>") == "a & b\n\n\nx".replace("\n\n\n", "\n\n") and one(spark, text.html_to_text, "<p> </p>") is None


@pytest.mark.parametrize("value, got", [("1700000000000", "2023-11-14 22:13:20"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("", None), ("soon", None), (None, None)])
def test_to_utc(spark, value, got):
    assert one(spark, lambda c: F.date_format(dates.to_utc(c), "yyyy-MM-dd HH:mm:ss"), value) == got


@pytest.mark.parametrize("value, end, got", [("2020-05", False, 2020 * 12 + 5), ("2020", False, 2020 * 12 + 1), ("2020", True, 2020 * 12 + 13), ("2020-13", False, None), ("May 2020", False, None)])
def test_months(spark, value, end, got):
    assert one(spark, lambda c: dates.month_ordinal(c, end), value) == got


@pytest.mark.parametrize("title, band", [("Senior Staff Engineer", "staff"), ("Principally an Engineer", None), ("Engineer", None), ("Trainee Lead", "lead"), ("Sr. Engineer", "senior"), (None, None)])
def test_bands(spark, title, band):
    assert one(spark, lookups.band, title) == band


@pytest.mark.parametrize("place, codes", [("Remote, United States", ["US"]), ("because of status", []), ("Ukraine", []), ("Austin", ["US"]), ("Springfield, TX", ["US"]), ("Paris and Berlin", ["DE", "FR"]), ("Kraków", ["PL"])])
def test_regions(spark, place, codes):
    assert one(spark, lookups.regions_named, place) == codes


@pytest.mark.parametrize("authorised, wanted, ok", [(["EU"], ["PL"], True), (["DE"], ["EU"], True), (["EU"], ["ES"], False), ([], ["US"], False), ([], [], True), (["US"], ["GB"], False)])
def test_covers(spark, authorised, wanted, ok):
    assert one(spark, lookups.covers, authorised, wanted, ddl="a array<string>, b array<string>") is ok


@pytest.mark.parametrize("met, missing, nbars, got", [(1, 7, 0, 12), (3, 5, 0, 38), (0, 0, 0, None), (5, 0, 1, 0), (2, 2, 0, 50)])
def test_score_rounds_halves_to_even(spark, met, missing, nbars, got):
    assert one(spark, scores.score, met, missing, nbars, ddl="a int, b int, c int") == got


def test_cosine(spark):
    d = "a array<float>, b array<float>"
    assert one(spark, scores.cosine_distance, [1.0, 0.0], [0.0, 2.0], ddl=d) == 1 and one(spark, scores.cosine_distance, [1.0, 1.0], [2.0, 2.0], ddl=d) == pytest.approx(0)
    assert one(spark, scores.cosine_distance, [0.0], [1.0], ddl=d) is None and one(spark, scores.cosine_distance, [0.0], [1.0, 2.0], ddl=d) is None


@pytest.mark.parametrize("mode, places, ok", [("remote", ["Oslo"], True), (None, ["Oslo"], False), (None, [], True), ("onsite", ["Berlin, DE"], True)])
def test_location_polarity(spark, mode, places, ok):
    p = filters.Profile(locations=["Berlin"])
    assert one(spark, lambda a, m: filters.pass_location(p, a, m), places, mode, ddl="a array<string>, m string") is ok


def test_seniority_drops_any_band_outside(spark):
    p = filters.Profile(seniority="senior")
    assert one(spark, lambda t: filters.pass_seniority(p, t), "Senior Staff Associate") is False and one(spark, lambda t: filters.pass_seniority(p, t), "Engineer") is True


@pytest.mark.parametrize("zone, lo", [("CET timezone (+/- 3 hours)", -2.0), ("UTC ± 3 h", None), ("PST +/-2h", -10.0), ("INSTANT +/- 2h", None)])
def test_zone_windows(spark, zone, lo):
    w = one(spark, bars.zone_window, zone)
    assert (w and w["lo"]) == lo


@pytest.mark.parametrize("said, claim, ok", [("cut 41 by 3", "cut 41 services by 3%", True), ("cut 42", "cut 41", False), ("no numbers", "12", True)])
def test_digits(spark, said, claim, ok):
    assert one(spark, validate.digits_grounded, said, claim) is ok


def test_skills_are_whole_members(spark):
    ask = lambda *w: one(spark, lambda a, b: validate.fabricated_skills(a, b), list(w), ["Languages: JavaScript, Postgres"], ddl="a array<string>, b array<string>")
    assert ask("Java", "JavaScript", "PostgreSQL", "Script") == ["Java", "Script"]


@pytest.mark.parametrize("url, got", [("https://boards.greenhouse.io/embed/job_board?for=acme", ("greenhouse", "acme")), ("https://jobs.lever.co/jobs https://jobs.lever.co/z", ("lever", "z")), ("https://x.org", None)])
def test_boards(spark, url, got):
    b = one(spark, text.detect_board, url)
    assert (b and (b["ats"], b["slug"])) == got


def test_few_texts_of_a_batch_are_strings_at_a_time(monkeypatch):
    import pyarrow as pa

    from postmill.functions import text

    class Batch:
        """A batch of which slices alone can be taken out."""

        rows = pa.array(["<p>a</p>", None, "", "b<br>c"] * 5)
        __len__ = lambda self: len(self.rows)

        def slice(self, at, n):
            assert n <= 3
            return self.rows.slice(at, n)

    monkeypatch.setattr(text, "TEXTS", 3, raising=False)
    assert text.html_to_text.func(Batch()).to_pylist() == ["a", None, None, "b\nc"] * 5
    assert text.html_to_text.func(pa.array([], pa.string())).to_pylist() == []


def test_forms_of_stored_skills_are_worked_out_once(spark):
    from postmill.operators.validate import fabricated_skills

    df = spark.createDataFrame([(["Postgre", "PostgreSQL", "k8s"], ["Stores: Postgres / Kafka", "k8s"]), (["x"], [])], "w array<string>, s array<string>")
    got = df.select(fabricated_skills(F.col("w"), F.col("s")).alias("bad"))
    assert [r["bad"] for r in got.collect()] == [["Postgre"], ["x"]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
