"""Evidence and the validator (CLS-10, VAL, JN-13..16, PRJ-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import ALIASES
from ..functions.text import is_supported
from ..operators import validate as V
from ..operators import vault as E
from ..session import table
from .base import query, squash_sql

_RUNS = "regexp_extract_all(coalesce({0}, ''), '\\d+')"


def _resumes(spark, d):
    """One résumé per conversation: its turns are the bullets of alternating roles."""
    c = table(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    per = c.groupBy(F.col("conv_id").alias("profile_id")).agg(turns.alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("master_resume"))
    work = F.transform("t", lambda x: F.struct(x["role"].alias("position"), F.concat(F.lit("Firm "), x["role"]).alias("name"), F.array(x["text"], F.lit("x")).alias("highlights")))
    skills = F.array(F.struct(F.lit("Languages: Python, Go").alias("name"), F.array().cast("array<string>").alias("keywords")), F.struct(F.lit("Data").alias("name"), F.array(F.lit("SQL")).alias("keywords")))
    papers = F.array(F.struct(F.lit("Licence").alias("name")))
    return per.select("profile_id", "master_resume", work.alias("work"), skills.alias("skills"), papers.alias("certificates"))


@query("""SELECT conv_id AS profile_id, 'title' AS kind, role AS text, 'work[' || turn || '].position' AS source FROM conversations UNION ALL
SELECT conv_id, 'bullet', text, 'work[' || turn || '].highlights[0]' FROM conversations WHERE length(trim(text)) >= 2 UNION ALL
SELECT conv_id, 'skill', unnest(['Python', 'Go']), 'skills[0].name' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
SELECT conv_id, 'skill', 'SQL', 'skills[1].keywords[0]' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
SELECT conv_id, 'credential', 'Licence', 'certificates[0].name' FROM (SELECT DISTINCT conv_id FROM conversations)""")
def claims_explode(spark, d):
    """CLS-10, ARR-07: flat claims with pointers; headings and one-letter claims go."""
    return E.claims(_resumes(spark, d))


_CITED = f"(SELECT d.doc_id, {squash_sql('d.text')} AS r, {squash_sql('b.text')} AS c FROM documents d, benchmark b, (SELECT count(*) AS n FROM benchmark) WHERE d.doc_id % n = b.item_id)"


@query(f"SELECT doc_id, length(c) > 0 AND contains(CASE WHEN doc_id % 3 = 0 THEN r || c ELSE r END, c) AS supported FROM {_CITED}")
def claim_supported(spark, d):
    """STR-16, VAL-01: whole items against whole texts, a third of which quote them."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("claim"))
    rows = table(spark, d, "documents").withColumn("i", F.col("doc_id") % F.lit(b.count())).join(b, "i")
    source = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n"), "claim")).otherwise(F.col("text"))
    return rows.select("doc_id", is_supported(F.col("claim"), source).alias("supported"))


@query(f"SELECT 'bullet' AS kind, count(*) AS n FROM conversations WHERE length({squash_sql('text')}) > 0 AND length(trim(text)) >= 2")
def vault_supported_bullets(spark, d):
    """DML-13: bullets that the résumé's own text bears out."""
    r = _resumes(spark, d)
    return E.supported(E.claims(r).where("kind = 'bullet'"), r).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id AS profile_id, count(*) AS claims, string_agg('Firm ' || role, ',' ORDER BY turn) AS companies, string_agg(role, ',' ORDER BY turn) AS titles, sha256(string_agg('E' || rn || ' [bullet] ' || replace(text, chr(10), ' '), chr(10) ORDER BY rn)) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def vault_built(spark, d):
    """VAL-09, STR-21: claims by handle, employers and titles of each résumé, and the list that a prompt shows."""
    rows = E.mint_handles(table(spark, d, "conversations").select(F.col("conv_id").alias("profile_id"), "turn", "text", F.lit("bullet").alias("kind"), F.lit("work").alias("source")), "profile_id", ["turn"])
    built = E.vaults(rows, _resumes(spark, d))
    numbered = F.transform(F.map_entries("claims"), lambda c: F.struct(F.substring(c["key"], 2, 9).cast("int").alias("n"), c["key"].alias("handle"), c["value"].alias("claim")))
    lines = F.transform(F.array_sort(numbered), lambda c: E.evidence_block(c["handle"], c["claim"]["kind"], c["claim"]["text"]))
    return built.select("profile_id", F.size("claims").cast("bigint").alias("claims"), F.array_join("companies", ",").alias("companies"), F.array_join("titles", ",").alias("titles"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("block"))


@query("SELECT l_orderkey, l_linenumber, p_name, c_name, handles FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, count(*) AS handles FROM orders GROUP BY 1) ON k = c_custkey WHERE c_custkey % 5 <> 0")
def work_assembled(spark, d):
    """JN-16: match, job, profile and vault of one piece of work; a profile that isn't parsed leaves none."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    matches = line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("job_id"), F.col("o_custkey").alias("user_id"))
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), "p_name")
    parsed = F.when(F.col("c_custkey") % 10 == 0, "{}").when(F.col("c_custkey") % 5 != 0, '{"work": []}')
    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("profile_id"), "c_name", parsed.alias("parsed_json"))
    evidence = o.groupBy(F.col("o_custkey").alias("profile_id")).agg(F.count("*").alias("handles"))
    return E.assembled(matches, jobs, profiles, evidence).select("l_orderkey", "l_linenumber", "p_name", "c_name", "handles")


@query("SELECT conv_id, turn, turn % 4 > 1 OR length(text) < 200 AS ok FROM conversations")
def empty_parse_guard(spark, d):
    """FLT-18: an empty parse of a long text replaces nothing."""
    work = F.when(F.col("turn") % 4 == 3, F.array("role")).otherwise(F.array().cast("array<string>"))
    skills = F.when(F.col("turn") % 4 == 2, F.array("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", E.may_rebuild(work, skills, F.col("text")).alias("ok"))


def _pairs(spark, d):
    """Each turn cites the turn before it in its conversation."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("claim"), F.when(F.col("turn") % 5 == 4, "skill").otherwise("bullet").alias("kind"))
    return c.join(before, ["conv_id", "turn"], "left")


def _own():
    """One employer and one title of one's own; a posting that names neither."""
    return V.own_words(F.array(F.lit("Acme Widgets")), F.array(F.lit("Senior Engineer")), F.lit(None).cast("string"), F.lit(""))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PAIRS = "(SELECT a.conv_id, a.turn, a.text, b.text AS claim, CASE WHEN b.turn % 5 = 4 THEN 'skill' ELSE 'bullet' END AS kind FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"
_GROUNDED = f"len(list_filter({_RUNS.format('text')}, lambda x: NOT list_contains({_RUNS.format('claim')}, x))) = 0"
_FREE, _SPELLED = _quoted(V.FREE_WORDS), _quoted(V.NUMBER_WORDS)


def _hay_sql(claim: str) -> str:
    """The claim, one's own words and fuller spellings, squashed."""
    fuller = "CASE w " + " ".join(f"WHEN '{k}' THEN '{''.join(v.lower().split())}'" for k, v in ALIASES.items()) + " END"
    return f"{squash_sql(claim)} || 'acmewidgetsseniorengineer' || array_to_string(list_filter(list_transform(regexp_extract_all(lower({claim}), '[a-z0-9]+'), lambda w: {fuller}), lambda w: w IS NOT NULL), '')"


#: Each turn with what its words are looked for in, its first number that isn't the claim's, and its words that claim something.
_JUDGED = f"""(SELECT *, {_hay_sql("coalesce(claim, '')")} AS hay, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: NOT list_contains({_RUNS.format('claim')}, x))[1] AS badnum,
list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({_FREE}, lower(w))) AS words FROM {_PAIRS})"""
_STRAY = "list_filter(words, lambda w: NOT contains(hay, lower(w)))"


@query(f"SELECT conv_id, turn, {_GROUNDED} AS grounded FROM {_PAIRS} WHERE claim IS NOT NULL")
def digit_runs_subset(spark, d):
    """VAL-02."""
    return _pairs(spark, d).where("claim IS NOT NULL").select("conv_id", "turn", V.digits_grounded(F.col("text"), F.col("claim")).alias("grounded"))


@query(f"SELECT conv_id, turn, CAST(len(list_distinct({_STRAY})) AS BIGINT) AS n, {_STRAY}[1] AS first FROM {_JUDGED} WHERE claim IS NOT NULL")
def tokens_grounded(spark, d):
    """VAL-03: words of a text that are neither free nor in the evidence, one's own employers and titles or fuller spellings."""
    rows = _pairs(spark, d).where("claim IS NOT NULL").select("conv_id", "turn", "text", V.haystack(F.col("claim"), _own()).alias("hay"))
    rows = rows.select("conv_id", "turn", V.ungrounded_tokens(F.col("text"), F.col("hay")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").cast("bigint").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


_FAULT = f"""CASE WHEN claim IS NULL THEN 'cites ' || conv_id || ':' || turn || ', which is not in the vault' WHEN kind <> 'bullet' THEN 'cites ' || conv_id || ':' || turn || ', a ' || kind || ' claim; a bullet must cite a bullet'
WHEN badnum IS NOT NULL THEN 'the number ' || badnum || ' is not in the cited evidence' WHEN {_STRAY}[1] IS NOT NULL THEN chr(39) || {_STRAY}[1] || chr(39) || ' does not appear in the cited evidence' END"""


@query(f"SELECT conv_id, turn, {_FAULT} AS fault FROM {_JUDGED}")
def first_fault(spark, d):
    """VAL-01, VAL-06, JN-13: provenance, numbers, words; the first fault is told."""
    c = table(spark, d, "conversations")
    handle = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    evidence = c.select(handle(F.col("turn") + 1).alias("handle"), "text", F.when(F.col("turn") % 5 == 4, "skill").otherwise("bullet").alias("kind"))
    return V.check_bullets(c.select("conv_id", "turn", "text", handle(F.col("turn")).alias("handle")), evidence, own=_own()).select("conv_id", "turn", "fault")


@query(f"""SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'skills not in the vault: COBOL, ' || conv_id WHEN stripped / n > 0.5 THEN CAST(CAST(round_even(100.0 * stripped / n, 0) AS BIGINT) AS VARCHAR) || '% of bullets were untraceable, ceiling 50%'
WHEN n - stripped < least(3, n) THEN 'only ' || (n - stripped) || ' traceable bullets, need ' || least(3, n) || CASE WHEN n < 3 THEN ' (capped from 3 by ' || n || ' in the vault)' ELSE '' END END AS verdict
FROM (SELECT conv_id, count(*) AS n, count(fault) AS stripped FROM (SELECT conv_id, CASE WHEN claim IS NULL THEN 'x' WHEN kind <> 'bullet' THEN 'x' END AS fault FROM {_PAIRS}) GROUP BY conv_id)""")
def verdict(spark, d):
    """VAL-07, AGG-11."""
    fault = F.when(F.col("claim").isNull() | (F.col("kind") != "bullet"), "x")
    per = _pairs(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), (F.count("*") - F.count(fault)).alias("kept"))
    bad = F.when(F.col("conv_id") % 10 == 0, F.array(F.lit("COBOL"), F.col("conv_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return per.select("conv_id", V.verdict(F.col("n"), F.col("kept"), bad, F.col("n")).alias("verdict"))


@query("SELECT 'conv[' || conv_id || ']' AS owner, string_agg(role, ',' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def group_by_owner(spark, d):
    """JN-15, AGG-20."""
    rows = table(spark, d, "conversations").select(F.format_string("conv[%d].turn[%d]", "conv_id", "turn").alias("source"), F.col("turn").alias("pos"), F.col("role").alias("text"))
    return E.by_owner(rows).select("owner", F.array_join("texts", ",").alias("texts"))


@query("SELECT conv_id, turn, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS handle FROM conversations")
def minted_handles(spark, d):
    """PRJ-13, WIN-06."""
    return E.mint_handles(table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "handle")


@query("SELECT DISTINCT p_brand AS owner, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS form FROM part")
def vault_skills(spark, d):
    """STR-19: members of skill lines by their squashed form."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.lit("skill").alias("kind"), F.col("p_partkey").alias("pos"), F.concat(F.lit("Kind: "), "p_name").alias("text"))
    return E.skill_names(rows, "owner").select("owner", "form")


_STORED = f"list_transform(list_concat(regexp_split_to_array(p_name, ' '), ['Postgres', 'PostgreSQL', 'Stores', p_brand, p_name]), lambda x: {squash_sql('x')})"


@query(f"SELECT p_partkey, array_to_string(list_filter([CASE p_partkey % 3 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'Postgre' ELSE 'Cobol' END, p_name, p_type, upper(p_brand), regexp_split_to_array(p_name, ' ')[1]], lambda s: NOT list_contains({_STORED}, {squash_sql('s')})), ',') AS bad FROM part")
def skills_checked(spark, d):
    """VAL-04: whole members and fuller spellings, never parts of a word."""
    stored = F.array(F.concat(F.lit("Stores: Postgres, "), F.regexp_replace("p_name", " ", ", "), F.lit(" / "), "p_brand"), F.col("p_name"))
    wanted = F.array(F.when(F.col("p_partkey") % 3 == 0, "PostgreSQL").when(F.col("p_partkey") % 3 == 1, "Postgre").otherwise("Cobol"), F.col("p_name"), F.col("p_type"), F.upper("p_brand"), F.split("p_name", " ")[0])
    return table(spark, d, "part").select("p_partkey", F.array_join(V.fabricated_skills(wanted, stored), ",").alias("bad"))


# The two turns before a turn are cited; every seventh turn cites one that isn't there.
_LETTERS = f"""(SELECT conv_id, turn, text, missing, {_hay_sql('cited')} AS hay, list_concat(regexp_extract_all(cited, '[0-9]+'), list_filter(regexp_extract_all(lower(cited), '[a-z0-9]+'), lambda w: list_contains({_SPELLED}, w))) AS nums
FROM (SELECT a.conv_id, a.turn, a.text, CASE WHEN a.turn % 7 = 6 THEN 'E99' END AS missing, concat_ws(' ', b.text, c.text) AS cited FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn - 1))"""
_SPELLED_BAD = f"list_contains({_SPELLED}, lower(w)) AND NOT list_contains(nums, lower(w))"
_LETTER_STRAY = f"list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: ({_SPELLED_BAD}) OR (NOT list_contains({_FREE}, lower(w)) AND regexp_matches(w, '^[A-Z]') AND NOT contains(hay, lower(w)) AND NOT (suffix(lower(w), 's') AND contains(hay, left(lower(w), length(w) - 1)))))[1]"
_LETTER_FAULT = f"""CASE WHEN missing IS NOT NULL THEN 'cites ' || missing || ', which is not in the vault' WHEN badnum IS NOT NULL THEN 'the number ' || badnum || ' is not in the cited evidence'
WHEN {_SPELLED_BAD.replace('(w)', '(stray)')} THEN 'the number ' || chr(39) || stray || chr(39) || ' is not in the cited evidence' WHEN stray IS NOT NULL THEN chr(39) || stray || chr(39) || ' does not appear in the cited evidence' END"""


@query(f"SELECT letter, place, fault, bool_or(fault IS NOT NULL) OVER (PARTITION BY letter) AS blocked FROM (SELECT conv_id AS letter, turn AS place, {_LETTER_FAULT} AS fault FROM (SELECT *, {_LETTER_STRAY} AS stray, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: NOT list_contains(nums, x))[1] AS badnum FROM {_LETTERS}))")
def letter_words(spark, d):
    """VAL-05, JN-14: paragraphs joined to all the claims they cite; numbers in digits and words, capitalised words with a plural allowed."""
    c = table(spark, d, "conversations")
    handle = lambda n: F.concat(F.lit("E"), n.cast("string"))
    turn = F.col("turn")
    cites = F.array_compact(F.array(F.when(turn >= 2, handle(turn - 2)), F.when(turn >= 1, handle(turn - 1)), F.when(turn % 7 == 6, "E99")))
    paragraphs = c.select(F.col("conv_id").alias("letter"), turn.alias("place"), "text", cites.alias("evidence_ids"))
    evidence = c.select(F.col("conv_id").alias("letter"), handle(turn).alias("handle"), "text")
    return V.check_letters(paragraphs, evidence, own=_own()).select("letter", "place", "fault", "blocked")


@query("SELECT conv_id, turn, CASE WHEN bool_or(turn % 4 = 3) OVER (PARTITION BY conv_id) THEN 'second' ELSE 'first' END AS draft FROM conversations")
def repaired_drafts(spark, d):
    """VAL-08: blocked letters are replaced by their second draft."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "bad").alias("fault"))
    return V.repaired(c.withColumn("draft", F.lit("first")), c.withColumn("draft", F.lit("second")), "conv_id").select("conv_id", "turn", "draft")
