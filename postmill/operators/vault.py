"""Evidence: claims taken from a parsed résumé, kept only where the résumé's own text bears them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import split_skill_line, squash

RESUME = "basics struct<location:string>, work array<struct<position:string,name:string,startDate:string,endDate:string,highlights:array<string>>>, skills array<struct<name:string,keywords:array<string>>>, projects array<struct<name:string,highlights:array<string>>>, certificates array<struct<name:string>>, years_experience double, work_authorization string"


def claims(resumes: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """(id, kind, text, source): one row per title, bullet, skill and credential, with a pointer to where it stands."""
    own = F.col(id_col)
    work = resumes.select(own, F.posexplode("work").alias("i", "w"))
    titles = work.select(own, F.lit("title").alias("kind"), F.col("w.position").alias("text"), F.format_string("work[%d].position", "i").alias("source"))
    bullets = work.select(own, "i", F.posexplode("w.highlights").alias("j", "text")).select(own, F.lit("bullet").alias("kind"), "text", F.format_string("work[%d].highlights[%d]", "i", "j").alias("source"))
    skills = resumes.select(own, F.posexplode("skills").alias("i", "s"))
    # a heading that introduces members makes no claim of its own
    heads = skills.where(F.coalesce(F.size("s.keywords"), F.lit(0)) <= 0).select(own, "i", F.posexplode(split_skill_line(F.col("s.name"))).alias("j", "text"), F.size(split_skill_line(F.col("s.name"))).alias("n"), F.col("s.name").contains(":").alias("headed"))
    heads = heads.where("NOT (headed AND n > 1 AND j = 0)").select(own, F.lit("skill").alias("kind"), "text", F.format_string("skills[%d].name", "i").alias("source"))
    words = skills.select(own, "i", F.posexplode("s.keywords").alias("j", "text")).select(own, F.lit("skill").alias("kind"), "text", F.format_string("skills[%d].keywords[%d]", "i", "j").alias("source"))
    papers = resumes.select(own, F.posexplode("certificates").alias("i", "c")).select(own, F.lit("credential").alias("kind"), F.col("c.name").alias("text"), F.format_string("certificates[%d].name", "i").alias("source"))
    out = titles
    for more in (bullets, heads, words, papers):
        out = out.unionByName(more)
    return out.where(F.length(F.trim("text")) >= 2)


def supported(claim_rows: DataFrame, resumes: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """Claims whose squashed text stands in the squashed résumé."""
    text = resumes.select(id_col, squash(F.col("master_resume")).alias("__r"))
    c = squash(F.col("text"))
    return claim_rows.join(text, id_col).where((F.length(c) > 0) & F.col("__r").contains(c)).drop("__r")


def companies(work: Column) -> Column:
    return F.filter(F.transform(work, lambda w: w["name"]), lambda n: F.coalesce(n != "", F.lit(False)))


def titles(work: Column) -> Column:
    return F.filter(F.transform(work, lambda w: w["position"]), lambda n: F.coalesce(n != "", F.lit(False)))


def vaults(evidence: DataFrame, resumes: DataFrame, owner: str = "profile_id") -> DataFrame:
    """(owner, claims, companies, titles): claims as a map of handle to kind, text and source; an owner without evidence has an empty one."""
    per = evidence.groupBy(owner).agg(F.map_from_entries(F.collect_list(F.struct("handle", F.struct("kind", "text", "source").alias("claim")))).alias("claims"))
    known = resumes.select(owner, companies(F.col("work")).alias("companies"), titles(F.col("work")).alias("titles"))
    none = F.create_map().cast("map<string,struct<kind:string,text:string,source:string>>")
    return known.join(per, owner, "left").select(owner, F.coalesce("claims", none).alias("claims"), "companies", "titles")


def assembled(matches: DataFrame, jobs: DataFrame, profiles: DataFrame, vault: DataFrame, parsed: str = "parsed_json") -> DataFrame:
    """Each match with its job, the profile of its user and that profile's vault; one that lacks any of them, or whose profile isn't parsed, is left out."""
    usable = profiles.where(F.col(parsed).isNotNull() & (F.col(parsed) != "{}"))
    return matches.join(jobs, "job_id").join(usable, "user_id").join(vault, "profile_id")


def evidence_block(handle: Column, kind: Column, text: Column) -> Column:
    """One line of the list of claims that a prompt shows."""
    return F.concat(handle, F.lit(" ["), kind, F.lit("] "), F.replace(text, F.lit("\n"), F.lit(" ")))


def may_rebuild(work: Column, skills: Column, resume: Column, least: int = 200) -> Column:
    """May a fresh parse replace what is stored: not where a long résumé gave neither work nor skills."""
    empty = (F.coalesce(F.size(work), F.lit(0)) <= 0) & (F.coalesce(F.size(skills), F.lit(0)) <= 0)
    return ~(empty & (F.length(F.coalesce(resume, F.lit(""))) >= least))


def mint_handles(evidence: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """E1, E2, … per owner, in the order given."""
    n = F.row_number().over(W.partitionBy(owner).orderBy(*order))
    return evidence.withColumn("handle", F.concat(F.lit("E"), n.cast("string")))


def owner_of(source: Column) -> Column:
    return F.substring_index(source, ".", 1)


def by_owner(bullets: DataFrame, source: str = "source", pos: str = "pos", text: str = "text") -> DataFrame:
    """Bullets of each entry, in order, as one list."""
    rows = F.array_sort(F.collect_list(F.struct(pos, text)))
    return bullets.groupBy(owner_of(F.col(source)).alias("owner")).agg(F.transform(rows, lambda r: r[text]).alias("texts"))


def skill_names(evidence: DataFrame, owner: str) -> DataFrame:
    """Skills of each owner by their squashed form, first spelling kept; a heading before members is dropped."""
    parts = split_skill_line(F.col("text"))
    rows = evidence.where("kind = 'skill'").select(owner, "pos", F.posexplode(F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(parts)).alias("i", "skill"))
    return rows.groupBy(owner, squash(F.col("skill")).alias("form")).agg(F.min_by("skill", F.struct("pos", "i")).alias("skill")).where("form <> ''")
