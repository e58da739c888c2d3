"""Projections and filters (PRJ, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import NO_SPONSORSHIP, outside_window, source_priority
from ..functions.text import any_word, join_nonempty, word_pattern
from ..operators import filters as O
from ..session import table
from .base import POSTINGS_SQL, WORD, postings, query

PROFILE = O.Profile(locations=["en, Anywhere", "fr"], remote_modes=["remote", "hybrid"], seniority="senior", work_auth="needs_sponsorship", must_have=["the"], exclude=["idiot", "c++"])
_B = rf"(^|[^{WORD}])", rf"([^{WORD}]|$)"
_BANNED = "|".join(_B[0] + w + _B[1] for w in outside_window("senior"))
_PASSES = f"""passes AS (SELECT *, (coalesce(len(locations), 0) = 0 OR coalesce(remote_mode = 'remote', false) OR list_has_any(regexp_split_to_array(trim(lower(array_to_string(locations, ','))), '\\s*,\\s*'), ['en', 'anywhere', 'fr'])) AS pass_location,
  (remote_mode IS NULL OR remote_mode IN ('remote', 'hybrid')) AS pass_remote, NOT coalesce(regexp_matches(title, '(?i){_BANNED}'), false) AS pass_seniority,
  NOT regexp_matches(lower(coalesce(description, '')), '{"|".join(NO_SPONSORSHIP)}') AS pass_work_auth,
  regexp_matches(title || ' ' || coalesce(description, ''), '(?i){_B[0]}the{_B[1]}') AND NOT regexp_matches(title || ' ' || coalesce(description, ''), '(?i){_B[0]}idiot{_B[1]}|{_B[0]}c\\+\\+') AS pass_keywords
  FROM postings WHERE NOT closed AND NOT duplicate)"""
_SCORED = "scored AS (SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1)"


def _passed(spark, d):
    """FLT-01, 03-08: pass columns of the open pool."""
    return O.with_passes(O.pool(postings(spark, d)), PROFILE)


@query(f"""WITH {POSTINGS_SQL}, {_PASSES}, {_SCORED}
SELECT CASE WHEN s.id IS NOT NULL THEN 'already_scored' WHEN NOT pass_location THEN 'dropped_location' WHEN NOT pass_remote THEN 'dropped_remote' WHEN NOT pass_seniority THEN 'dropped_seniority'
 WHEN NOT pass_work_auth THEN 'dropped_work_auth' WHEN NOT pass_keywords THEN 'dropped_keywords' ELSE 'candidates' END AS bucket, count(*) AS n FROM passes p LEFT JOIN scored s ON p.id = s.id GROUP BY 1""")
def filter_funnel(spark, d):
    """FLT-01..09, PRJ-03, JN-04, AGG-04: the whole funnel, one scan."""
    matches = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 1).alias("score"))
    return O.funnel(O.already_scored(_passed(spark, d), matches, "id"))


@query(f"WITH {POSTINGS_SQL}, {_PASSES} SELECT id, pass_location, pass_remote, pass_seniority, pass_work_auth, pass_keywords FROM passes")
def pass_columns(spark, d):
    """PRJ-03: one boolean per filter."""
    return _passed(spark, d).select("id", "pass_location", "pass_remote", "pass_seniority", "pass_work_auth", "pass_keywords")


@query(rf"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i){_B[0]}(die|les|re){_B[1]}') GROUP BY lang")
def keyword_whole_word(spark, d):
    """FLT-07, FLT-08."""
    return table(spark, d, "documents").where(any_word(F.col("text"), ["die", "les", "re"])).groupBy("lang").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, regexp_matches(text, '(?i){_B[0]}is\.') AS dotted, regexp_matches(text, '(?i)!!') AS bangs FROM documents")
def keyword_punct_boundary(spark, d):
    """FLT-08: no boundary on a side that is punctuation."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(word_pattern("is.")).alias("dotted"), t.rlike(word_pattern("!!")).alias("bangs"))


@query(rf"WITH {POSTINGS_SQL} SELECT id, coalesce(regexp_matches(title, '(?i){_BANNED}'), false) AS forbidden FROM postings")
def any_forbidden_term(spark, d):
    """FLT-05: any keyword of a band outside the window."""
    return postings(spark, d).select("id", any_word(F.col("title"), outside_window("senior")).alias("forbidden"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%idiot%' OR text ILIKE '%licensed under%'")
def phrase_ilike_drop(spark, d):
    """FLT-06, FLT-24."""
    return table(spark, d, "documents").where(F.col("text").ilike("%idiot%") | F.col("text").ilike("%licensed under%")).select("doc_id")


@query(rf"WITH {POSTINGS_SQL} SELECT location, count(*) AS n FROM postings WHERE list_has_any(regexp_split_to_array(trim(lower(array_to_string(locations, ','))), '\s*,\s*'), ['src0', 'de']) GROUP BY location")
def location_segment_overlap(spark, d):
    """FLT-03, ARR-02, ARR-03."""
    hit = F.arrays_overlap(O.segments(F.col("locations")), F.array(F.lit("src0"), F.lit("de")))
    return postings(spark, d).where(hit).groupBy("location").agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS_SQL} SELECT coalesce(remote_mode, 'unknown') AS mode, count(*) AS n, count(*) FILTER (WHERE len(locations) = 0) AS nowhere FROM postings WHERE NOT closed AND NOT duplicate AND (remote_mode IS NULL OR remote_mode = 'remote') GROUP BY 1")
def null_polarity_pool(spark, d):
    """FLT-01, FLT-04, ARR-01: unknown passes."""
    p = O.pool(postings(spark, d)).where(O.pass_remote(O.Profile(remote_modes=["remote"]), F.col("remote_mode")))
    return p.groupBy(F.coalesce("remote_mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("n"), F.count_if(F.size("locations") == 0).alias("nowhere"))


@query("""SELECT array_to_string(list_filter([CASE WHEN c_nationkey < 20 THEN 'location' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'remote' END, CASE WHEN c_acctbal > 0 THEN 'seniority' END, CASE WHEN c_custkey % 3 = 0 THEN 'work_auth' END], lambda x: x IS NOT NULL), ',') AS active, count(*) AS n
FROM customer GROUP BY 1""")
def active_filters(spark, d):
    """FLT-10, FLT-11: which filters a profile switches on."""
    on = F.array(F.when(F.col("c_nationkey") < 20, "location"), F.when(F.col("c_mktsegment") == "MACHINERY", "remote"), F.when(F.col("c_acctbal") > 0, "seniority"), F.when(F.col("c_custkey") % 3 == 0, "work_auth"))
    return table(spark, d, "customer").groupBy(F.array_join(F.array_compact(on), ",").alias("active")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS_SQL} SELECT id, sha256(concat_ws(chr(10), nullif(title, ''), company, coalesce(nullif(array_to_string(locations, ', '), ''), location), left(description, 8000))) AS digest, left(concat_ws(' ', coalesce(nullif(title, ''), 'not stated'), company), 100) AS head FROM postings")
def embed_text_projection(spark, d):
    """PRJ-02, PRJ-04, PRJ-06, PRJ-12, STR-22."""
    place = F.coalesce(F.nullif(F.array_join("locations", ", "), F.lit("")), F.col("location"))
    title = F.nullif(F.col("title"), F.lit(""))
    text = F.concat_ws("\n", title, "company", place, F.substring("description", 1, 8000))
    return postings(spark, d).select("id", F.sha2(text.cast("binary"), 256).alias("digest"), F.substring(F.concat_ws(" ", F.coalesce(title, F.lit("not stated")), "company"), 1, 100).alias("head"))


@query("SELECT conv_id, sha256(concat_ws(chr(10), string_agg(role, ', ' ORDER BY turn), CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'senior' END, left(string_agg(text, ' ' ORDER BY turn), 8000))) AS digest FROM conversations GROUP BY conv_id")
def query_text(spark, d):
    """PRJ-05: wished titles, seniority and the head of the résumé, as they are embedded."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    titles, resume = F.transform("t", lambda t: t["role"]), F.array_join(F.transform("t", lambda t: t["text"]), " ")
    return per.select("conv_id", F.sha2(O.query_text(titles, F.when(F.col("conv_id") % 3 != 0, "senior"), resume).cast("binary"), 256).alias("digest"))


_SOURCES = "SELECT *, ['greenhouse','lever','remotive','jobspy:indeed','unlisted','ashby'][1 + o_orderkey % 6] AS src FROM orders"


@query(f"SELECT CASE WHEN src LIKE 'jobspy:%' THEN 2 WHEN src IN ('greenhouse','lever','ashby') THEN 0 WHEN src = 'remotive' THEN 1 ELSE 99 END AS priority, count(*) AS n FROM ({_SOURCES}) GROUP BY 1")
def priority_case(spark, d):
    """PRJ-08, MAP-01."""
    src = F.element_at(F.array(*(F.lit(x) for x in ["greenhouse", "lever", "remotive", "jobspy:indeed", "unlisted", "ashby"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").groupBy(source_priority(src).alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE a IS DISTINCT FROM b) AS differ, count(*) FILTER (WHERE a <> b) AS plain FROM (SELECT nullif(quality, 0) AS a, nullif(toxic, 0) AS b FROM labels)")
def is_distinct_from(spark, d):
    """FLT-23."""
    a, b = F.nullif("quality", F.lit(0)), F.nullif("toxic", F.lit(0))
    return table(spark, d, "labels").agg(F.count_if(~a.eqNullSafe(b)).alias("differ"), F.count_if(a != b).alias("plain"))


@query("SELECT s_suppkey, nullif(concat_ws(', ', nullif(trim(n_name), ''), nullif(CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE r_name END, '')), '') AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def joined_place(spark, d):
    """STR-14, CLS-05, JN-16."""
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("s_suppkey", join_nonempty(F.col("n_name"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("r_name"))).alias("place"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 7 <> 3 GROUP BY s_nationkey")
def active_boards(spark, d):
    """FLT-12, FLT-14, FLT-26: status gates."""
    status, ats = F.when(F.col("s_acctbal") > 0, "active").otherwise("retired"), F.when(F.col("s_suppkey") % 7 == 3, "other").otherwise("lever")
    return table(spark, d, "supplier").where((status == "active") & (ats != "other")).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('signup', 'view') AND props::VARCHAR <> '{}' AND NOT event_type ILIKE 'sign%' GROUP BY user_id")
def parsed_only(spark, d):
    """FLT-13, FLT-16, FLT-25."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "view") & (F.col("props") != "{}") & ~F.col("event_type").ilike("sign%"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"))
