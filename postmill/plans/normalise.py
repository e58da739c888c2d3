"""Normalisers, duplicates and string functions (STR, WIN, DML-06..08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lookups import ALIASES
from ..operators import dedupe as D
from ..session import table
from .base import query, squash_sql

_COMPANIES = ["Acme Widgets Inc", "ACME WIDGETS, LLC", "Société Générale S.A.", "Limited", "Übung & Söhne GmbH", "Zeta", "Škoda Auto a.s.", "Türkiye İş Bankası", "Győri Kft", "Česko s.r.o.", "Coöperatie Łódź B.V."]
_NAMES = """['Acme Widgets Inc', 'ACME WIDGETS, LLC', 'Société Générale S.A.', 'Limited', 'Übung & Söhne GmbH', 'Zeta', 'Škoda Auto a.s.', 'Türkiye İş Bankası', 'Győri Kft', 'Česko s.r.o.', 'Coöperatie Łódź B.V.'][1 + p_partkey % 11] || ' ' || CASE WHEN p_partkey % 6 = 5 THEN p_brand || ' Ltd.' ELSE '' END"""
_TITLES = """['Sr. ' || p_name || ' (m/w/d)', p_name || ' - 744123', 'Jr ' || p_name || ' & Co', p_name || ', #259', upper(p_name) || ' (All Genders)', p_name][1 + p_partkey % 6]"""


def _pick(values, key="p_partkey"):
    return F.element_at(F.array(*values), (F.col(key) % len(values) + 1).cast("int"))


def _name():
    extra = F.when(F.col("p_partkey") % 6 == 5, F.concat(F.col("p_brand"), F.lit(" Ltd."))).otherwise("")
    return F.concat(_pick([F.lit(x) for x in _COMPANIES]), F.lit(" "), extra)


def _title():
    p = F.col("p_name")
    return _pick([F.concat(F.lit("Sr. "), p, F.lit(" (m/w/d)")), F.concat(p, F.lit(" - 744123")), F.concat(F.lit("Jr "), p, F.lit(" & Co")), F.concat(p, F.lit(", #259")), F.concat(F.upper(p), F.lit(" (All Genders)")), p])


_SUFFIX = "list_has_any([w[-1]], ['inc','incorporated','llc','llp','ltd','limited','corp','corporation','co','company','gmbh','mbh','ag','se','bv','nv','sa','sas','srl','spa','ab','as','oy','plc','pty','pte','kk','kft','aps','sro','ug'])"


def _tokens_sql(x):
    return f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^a-z0-9]+'), lambda t: t <> '')"


_COMPANY_SQL = f"(SELECT *, CASE WHEN len(w) > 1 AND {_SUFFIX} THEN array_to_string(w[:-2], '') ELSE array_to_string(w, '') END AS company FROM (SELECT *, {_tokens_sql(f'''replace({_NAMES}, '.', '')''')} AS w FROM part))"
_CLEAN = f"replace(trim(regexp_replace(regexp_replace(trim({_TITLES}), '(?i)\\(\\s*([mfwdx](\\s*/\\s*[mfwdx])+|all\\s+genders?)\\s*\\)\\s*$', ''), '(?i)[-–—(\\[]\\s*(req[-\\s]?)?[a-z]{{0,3}}[-\\s]?\\d{{3,}}\\s*[)\\]]?\\s*$', '')), '&', ' and ')"
_TITLE_SQL = f"array_to_string(list_transform({_tokens_sql(_CLEAN)}, lambda t: CASE t WHEN 'sr' THEN 'senior' WHEN 'snr' THEN 'senior' WHEN 'jr' THEN 'junior' WHEN 'mgr' THEN 'manager' ELSE t END), '')"


@query("SELECT doc_id, sha256(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g')) AS digest FROM documents")
def squash_text(spark, d):
    """STR-01: NFKD of whole texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2(X.squash(F.col("text")).cast("binary"), 256).alias("digest"))


@query(f"SELECT company, count(*) AS n FROM {_COMPANY_SQL} GROUP BY company")
def normalize_company(spark, d):
    """STR-02."""
    return table(spark, d, "part").groupBy(X.normalize_company(_name()).alias("company")).agg(F.count("*").alias("n"))


@query(f"SELECT {_TITLE_SQL} AS title, count(*) AS n FROM part GROUP BY 1")
def normalize_title(spark, d):
    """STR-03."""
    return table(spark, d, "part").groupBy(X.normalize_title(_title()).alias("title")).agg(F.count("*").alias("n"))


@query(f"SELECT key, count(*) AS n FROM (SELECT CASE WHEN company <> '' AND {_TITLE_SQL} <> '' THEN concat_ws('|', company, {_TITLE_SQL}, {squash_sql('p_type')}) END AS key FROM {_COMPANY_SQL}) GROUP BY key")
def dedupe_key(spark, d):
    """STR-04, STR-05."""
    key = X.dedupe_key(_name(), _title(), F.concat(F.col("p_type"), F.lit(", Somewhere")))
    return table(spark, d, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


_JOBS_SQL = "(SELECT p_partkey AS id, ['greenhouse', 'jobspy:indeed', 'remotive', 'unlisted'][1 + p_partkey % 4] AS source, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name || '|' || p_size % 5 END AS dedupe_key, p_partkey % 8 = 0 AS closed, CASE WHEN p_partkey % 10 = 1 THEN p_partkey + 1 END AS canonical_id FROM part)"
_PRIO = "CASE WHEN source LIKE 'jobspy:%' THEN 2 WHEN source = 'greenhouse' THEN 0 WHEN source = 'remotive' THEN 1 ELSE 99 END"
_WIN = f"SELECT id, source, canonical_id, first_value(source) OVER w AS winner_source, first_value(id) OVER w AS winner_id FROM {_JOBS_SQL} WHERE NOT closed WINDOW w AS (PARTITION BY coalesce(dedupe_key, CAST(id AS VARCHAR)) ORDER BY {_PRIO}, id)"
_NEW = f"SELECT *, CASE WHEN source = winner_source THEN NULL ELSE nullif(winner_id, id) END AS fresh FROM ({_WIN})"


def _jobs(spark, d):
    p = table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("id"), _pick([F.lit(x) for x in ["greenhouse", "jobspy:indeed", "remotive", "unlisted"]]).alias("source"),
                    F.when(size % 10 != 0, F.concat_ws("|", "p_name", (size % 5).cast("string"))).alias("dedupe_key"), F.when(k % 8 == 0, F.lit("2024-01-01")).alias("closed_at"), F.when(k % 10 == 1, k + 1).alias("canonical_id"))


@query(f"SELECT key, closed, count(*) AS n FROM (SELECT p_partkey % 8 = 0 AS closed, CASE WHEN p_size % 10 = 0 AND p_partkey % 8 <> 0 THEN CASE WHEN company <> '' AND {_TITLE_SQL} <> '' THEN concat_ws('|', company, {_TITLE_SQL}, {squash_sql('p_type')}) END WHEN p_size % 10 <> 0 THEN p_name END AS key FROM {_COMPANY_SQL}) GROUP BY 1, 2")
def key_fill(spark, d):
    """DML-06: open rows without a key get one; closed ones and those that have one keep what they have."""
    p = table(spark, d, "part").select(_name().alias("company"), _title().alias("title"), F.col("p_type").alias("location"), F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("dedupe_key"), F.when(F.col("p_partkey") % 8 == 0, F.lit("2024-01-01")).alias("closed_at"))
    return D.fill_keys(p).groupBy(F.col("dedupe_key").alias("key"), F.col("closed_at").isNotNull().alias("closed")).agg(F.count("*").alias("n"))


@query(f"SELECT id, winner_source, winner_id FROM ({_WIN})")
def dedupe_winner(spark, d):
    """WIN-01: source and id of the first row of each key."""
    return D.winners(_jobs(spark, d).where("closed_at IS NULL")).select("id", "winner_source", "winner_id")


@query(f"SELECT id, fresh AS canonical_id, CASE WHEN fresh IS DISTINCT FROM canonical_id THEN CASE WHEN fresh IS NULL THEN 'promoted' ELSE 'duplicate' END ELSE 'none' END AS change FROM ({_NEW}) UNION ALL SELECT id, canonical_id, 'none' FROM {_JOBS_SQL} WHERE closed")
def dedupe_canonical(spark, d):
    """DML-07, JN-07: the canonical row of every open one."""
    return D.assign_canonical(_jobs(spark, d)).select("id", "canonical_id", "change")


@query(f"SELECT count(*) FILTER (WHERE fresh IS DISTINCT FROM canonical_id AND fresh IS NOT NULL) AS duplicates, count(*) FILTER (WHERE fresh IS DISTINCT FROM canonical_id AND fresh IS NULL) AS promoted FROM ({_NEW})")
def dedupe_counts(spark, d):
    """AGG-04."""
    return D.assign_canonical(_jobs(spark, d)).agg(F.count_if(F.col("change") == "duplicate").alias("duplicates"), F.count_if(F.col("change") == "promoted").alias("promoted"))


@query("SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, first_value(o_orderkey) OVER w AS survivor FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)")
def collapse_same_title(spark, d):
    """DML-08, WIN-03."""
    rows = D.collapse(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", F.col("rn").cast("bigint").alias("rn"), "survivor")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups_having(spark, d):
    """AGG-02."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS slug, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') = 'supplier' || printf('%09d', s_suppkey) AS same FROM supplier")
def slug_identity(spark, d):
    """STR-06, CLS-12."""
    slug = X.slugify(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", slug.alias("slug"), (slug == F.concat(F.lit("supplier"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("same"))


@query(r"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array('Tools: ' || p_name || ', ' || p_type || ' · ' || p_brand || '  end', '[:,;·|/]|\s{2,}'), lambda x: trim(x)), lambda x: x <> ''), '+') AS parts FROM part")
def split_skill_line(spark, d):
    """STR-09."""
    line = F.concat(F.lit("Tools: "), "p_name", F.lit(", "), "p_type", F.lit(" · "), "p_brand", F.lit("  end"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.split_skill_line(line), "+").alias("parts"))


@query("SELECT p_type, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(string_agg(p_name, ',' ORDER BY p_partkey), ','), lambda x: trim(x)), lambda x: length(x) > 2))), ',') AS terms FROM part GROUP BY p_type")
def search_terms(spark, d):
    """STR-10, STR-18: members after the colon, distinct and sorted."""
    named = table(spark, d, "part").groupBy("p_type").agg(F.array_distinct(F.collect_list("p_name")).alias("names"))
    return named.select("p_type", F.array_join(F.array_sort(F.filter(X.members(F.concat_ws(": ", "p_type", F.array_join("names", ", "))), lambda x: F.length(x) > 2)), ",").alias("terms"))


@query("SELECT doc_id, contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ', ' of the ') AS hit FROM documents")
def phrase_in_bag(spark, d):
    """STR-11."""
    return table(spark, d, "documents").select("doc_id", X.has_phrase(X.token_bag(F.col("text")), F.lit("Of the")).alias("hit"))


_SHORT = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " END"
_WORDS = "list_concat(regexp_split_to_array(lower(text), '[^a-z0-9]+'), [['Rust', 'Post-gres', 'J.S.', 'jsonschema', 'K8s'][1 + doc_id % 5]])"


@query(f"SELECT d.doc_id, coalesce(fuller, '') AS fuller FROM documents d LEFT JOIN (SELECT doc_id, string_agg(DISTINCT f, ',' ORDER BY f) AS fuller FROM (SELECT doc_id, {_SHORT} AS f FROM (SELECT doc_id, {squash_sql('x')} AS w FROM (SELECT doc_id, unnest({_WORDS}) AS x FROM documents))) WHERE f IS NOT NULL GROUP BY doc_id) USING (doc_id)")
def alias_expansion(spark, d):
    """STR-12: every word of a text, and some spellings."""
    more = F.array(_pick([F.lit(x) for x in ["Rust", "Post-gres", "J.S.", "jsonschema", "K8s"]], "doc_id"))
    words = F.array_distinct(F.concat(F.split(F.lower("text"), "[^a-z0-9]+"), more))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(words, X.expand_alias)))), ",").alias("fuller"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(trim(text), '[ \t]{2,}', ' ', 'g')) || CASE WHEN turn % 2 = 0 THEN ' said this.' ELSE '' END AS clean FROM (SELECT conv_id, turn, regexp_replace(text, '\s+([.,;:!?])', '\1', 'g') AS text FROM conversations)")
def strip_handles(spark, d):
    """STR-13: handles written into whole texts go, with the blanks they leave."""
    text = F.concat(F.lit("(E"), F.col("turn").cast("string"), F.lit(") "), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" said [E1, E"), F.col("conv_id").cast("string"), F.lit("]  this E3 ."))).otherwise(F.lit(" [E7]")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_handles(text).alias("clean"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '/+$', '') AS key, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def url_key(spark, d):
    """STR-15, SRC-13."""
    return table(spark, d, "pages").select("page_id", X.url_key(F.col("url")).alias("key"), X.domain_of(F.col("url")).alias("host"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS digest FROM pages")
def digest_id(spark, d):
    """SRC-15: an id for rows without one."""
    return table(spark, d, "pages").select("page_id", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16).alias("digest"))
