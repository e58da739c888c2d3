"""Classifiers and bars (CLS, BAR, MTH-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import bars as B
from ..operators.evaluation import reachable
from ..session import table
from .base import WORD, query

_L, _R = rf"(^|[^{WORD}])", rf"([^{WORD}]|$)"
_TITLES = ["Senior Staff Engineer", "Jr. Analyst", "Head of Sales", "Engineer", "Lead Trainee", "Principal Solutions Architect", "Technical Support Associate"]
_TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "][1 + doc_id % 7]"
_BAND_SQL = "CASE " + " ".join("WHEN regexp_matches({0}, '(?i)" + "|".join(_L + w + _R for w in words).replace("{", "{{").replace("}", "}}") + f"') THEN '{name}'" for name, words in L.BANDS) + " END"
_RANK_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.RANKS.items()) + " END"
_PLACES = ["Remote, United States", "Paris or Berlin", "London", "", "Europe", "Springfield, TX", "Asia, Europe, worldwide", "Tokyo"]
_PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "][1 + doc_id % 8]"


def _region_sql(x):
    out = []
    for code, words in L.REGIONS.items():
        hit = f"regexp_matches({x}, '(?i)" + "|".join(_L + w.replace(".", r"\.") + _R for w in words) + "')"
        if code == "US":
            hit = f"({hit} OR " + " OR ".join(f"contains(lower({x}), '{c}')" for c in L.US_CITIES) + f" OR regexp_matches({x}, '(?i),\\s*({'|'.join(L.US_STATES)}){_R}'))"
        out.append(f"CASE WHEN {hit} THEN '{code}' END")
    return f"list_sort(list_filter([{', '.join(out)}], lambda c: c IS NOT NULL))"


def _pick(values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def _head():
    """A fixed title and the table's own whole text."""
    return F.concat_ws(" ", _pick(_TITLES), "text")


_HEAD_SQL = f"({_TITLE_SQL} || ' ' || text)"


@query(f"SELECT doc_id, {_BAND_SQL.format(_HEAD_SQL)} AS band FROM documents")
def title_band(spark, d):
    """CLS-01: order of precedence, not of rank."""
    return table(spark, d, "documents").select("doc_id", L.band(_head()).alias("band"))


@query(f"SELECT delta, count(*) AS n FROM (SELECT {_RANK_SQL.format(_BAND_SQL.format(_HEAD_SQL))} - 3 AS delta FROM documents) GROUP BY delta")
def band_distance(spark, d):
    """MTH-03."""
    delta = L.band_distance(F.lit("senior"), L.band(_head()))
    return table(spark, d, "documents").groupBy(delta.alias("delta")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(r, ',') AS regions FROM (SELECT doc_id, {_region_sql(f"({_PLACE_SQL} || chr(10) || text)")} AS r FROM documents)")
def region_named(spark, d):
    """CLS-06, JN-08: a place and a whole text."""
    return table(spark, d, "documents").select("doc_id", F.array_join(L.regions_named(F.concat_ws("\n", _pick(_PLACES), "text")), ",").alias("regions"))


_WIDE = "list_concat(a, CASE WHEN list_contains(a, 'EU') THEN ['DE', 'FR', 'NL', 'IE', 'PL', 'IT'] ELSE [] END)"
_HOMES_SQL = "(CASE doc_id % 3 WHEN 0 THEN ['EU'] WHEN 1 THEN ['US', 'JP'] ELSE ['DE'] END)"
_COVERS = f"(len(r) = 0 OR (list_contains(r, 'EU') AND list_has_any({_WIDE}, ['DE', 'FR', 'NL', 'IE', 'PL', 'IT'])) OR list_has_any({_WIDE}, r))"
_OPEN = "(len(r) >= 3 OR (" + " + ".join(f"CAST(contains(lower(p), '{c}') AS INT)" for c in L.CONTINENTS) + ") >= 2 OR (len(r) = 0 AND (" + " OR ".join(f"contains(lower(p), '{g}')" for g in L.GLOBAL_PHRASES) + ")))"
_PLACED = f"(SELECT doc_id, {_PLACE_SQL} AS p, {_region_sql(_PLACE_SQL)} AS r, {_HOMES_SQL} AS a FROM documents)"


def _home():
    return F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("EU"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("US"), F.lit("JP"))).otherwise(F.array(F.lit("DE")))


@query(f"SELECT covered, open, count(*) AS n FROM (SELECT {_COVERS} AS covered, {_OPEN} AS open FROM {_PLACED}) GROUP BY 1, 2")
def region_covers(spark, d):
    """CLS-07, CLS-08."""
    place, named = _pick(_PLACES), L.regions_named(_pick(_PLACES))
    return table(spark, d, "documents").groupBy(L.covers(_home(), named).alias("covered"), L.open_to_world(place, named).alias("open")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CASE WHEN len(r) > 0 AND p <> '' AND NOT {_OPEN} AND NOT {_COVERS} THEN 'role is based in ' || array_to_string(r, '/') || '; profile is authorised to work in ' || array_to_string(list_sort(a), '/') END AS bar FROM {_PLACED}")
def country_bar(spark, d):
    """BAR-01."""
    places = F.filter(F.array(_pick(_PLACES)), lambda p: p != "")
    return table(spark, d, "documents").select("doc_id", B.country_bar(places, _home()).alias("bar"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN true ELSE {_OPEN} OR (len(r) > 0 AND {_COVERS}) END AS reachable FROM {_PLACED}")
def reachable_strict(spark, d):
    """FLT-20: only places that are known to be reached; nothing authorised reaches everything."""
    home = F.when(F.col("doc_id") % 4 != 3, _home())
    return table(spark, d, "documents").select("doc_id", reachable(F.array(_pick(_PLACES)), home).alias("reachable"))


_AUTHS = ["US citizen", "needs sponsorship to work", "no sponsorship required", "green card", "happy", "Requires sponsorship; citizen of France"]


@query("SELECT doc_id, ['citizen', 'needs_sponsorship', 'visa_holder', 'permanent_resident', NULL, 'needs_sponsorship'][1 + doc_id % 6] AS auth FROM documents")
def work_auth_phrase(spark, d):
    """CLS-03: the negated need before the need."""
    return table(spark, d, "documents").select("doc_id", L.work_auth(_pick(_AUTHS)).alias("auth"))


@query("SELECT doc_id, [NULL, 'FR', NULL, 'DE,US'][1 + doc_id % 4] AS regions FROM documents")
def work_auth_clauses(spark, d):
    """CLS-04: polarity clause by clause."""
    texts = ["Requires sponsorship in the United States", "Citizen of France. Needs sponsorship in the US", "nothing said", "Authorized to work in Germany; US national"]
    return table(spark, d, "documents").select("doc_id", F.array_join(L.work_auth_regions(_pick(texts)), ",").alias("regions"))


_WINDOWS = ["CET timezone (+/- 3 hours)", "PST +/- 2h", "UTC ± 3 h", "within GMT zone +/-1.5 hours", "any"]


@query(f"SELECT doc_id, [-2.0, -10.0, NULL, -1.5, NULL][1 + doc_id % 5] AS lo, [4.0, -6.0, NULL, 1.5, NULL][1 + doc_id % 5] AS hi, CASE doc_id % 5 WHEN 0 THEN doc_id % 3 = 1 WHEN 1 THEN doc_id % 3 <> 1 WHEN 3 THEN doc_id % 3 = 1 ELSE false END AS barred FROM documents")
def interval_overlap_bar(spark, d):
    """BAR-05, JN-17, CLS-09: a stated window against the ranges of home regions."""
    text = _pick(_WINDOWS)
    home = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Berlin"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("Denver, CO"))).otherwise(F.array(F.lit("Dublin")))
    w = B.zone_window(text)
    return table(spark, d, "documents").select("doc_id", w["lo"].alias("lo"), w["hi"].alias("hi"), B.zone_bar(text, home).isNotNull().alias("barred"))


_DEMANDS = ["PHP is a must.", "Go and Java are required", "Ruby is nice. Scala is essential", "Elixir/Phoenix experience is mandatory", "C# 7.0 is required", "we like Rust"]


@query("SELECT doc_id, ['PHP', 'Go', 'Scala', 'Elixir', NULL, NULL][1 + doc_id % 6] AS lang FROM documents")
def mandatory_term_bar(spark, d):
    """BAR-06: mandatory within the sentence, no evidence in the résumé."""
    resume = F.lit("Wrote C# and Java services")
    bar = B.coding_bar(_pick(_DEMANDS), resume)
    return table(spark, d, "documents").select("doc_id", F.nullif(F.regexp_extract(bar, r"^posting states (\S+) as", 1), F.lit("")).alias("lang"))


_LANGS = ["Bilingual English/Mandarin is required", "fluent in German", "Mandarin required", "couramment le français", "French bread"]


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE doc_id % 5 WHEN 0 THEN 'Mandarin' WHEN 2 THEN 'Mandarin' WHEN 3 THEN 'French' END,
CASE WHEN doc_id % 7 IN (5) THEN 'customer-facing architecture' WHEN doc_id % 7 = 6 THEN 'technical support' END, CASE WHEN doc_id % 2 = 0 THEN 'student' END], lambda x: x IS NOT NULL), ',') AS bars FROM documents""")
def bars_array(spark, d):
    """BAR-02..04, BAR-07: bars in their fixed order, gaps closed."""
    resume = F.lit("I speak German and closed tickets")
    lang = F.nullif(F.regexp_extract(B.language_bar(_pick(_LANGS), resume), "requires ([A-Z][a-z]+);", 1), F.lit(""))
    family = F.nullif(F.regexp_extract(B.family_bar(_pick(_TITLES), resume), "role is ([^;]+);", 1), F.lit(""))
    student = F.when(B.student_bar(F.when(F.col("doc_id") % 2 == 0, "You must be currently enrolled.").otherwise("Open to all"), F.lit("Senior")).isNotNull(), "student")
    return table(spark, d, "documents").select("doc_id", F.array_join(B.bars(lang, family, student), ",").alias("bars"))


@query(f"SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'lead' END, CASE WHEN c_acctbal < 2000 THEN 'junior' WHEN c_acctbal < 5000 THEN 'mid' WHEN c_acctbal < 9000 THEN 'senior' ELSE 'staff' END) AS seniority FROM customer")
def seniority_of_resume(spark, d):
    """CLS-02: the newest role's band, else by years."""
    from ..functions.careers import seniority

    title = F.when(F.col("c_custkey") % 4 == 0, "Team Lead").otherwise("Engineer")
    return table(spark, d, "customer").select("c_custkey", seniority(title, F.col("c_acctbal") / 1000).alias("seniority"))
