"""The registry of boards: which names to look up next, and what a lookup found."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_board, slugify


def candidates(jobs: DataFrame, name: str, least: int, most: int) -> DataFrame:
    """Names with ``least`` rows or more, the most frequent first."""
    return jobs.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), name).limit(most)


def without_recent(names: DataFrame, name: str, tried: DataFrame, run: dt.datetime, days: int) -> DataFrame:
    """``names`` whose slug has no try (slug, tried_at) within ``days`` of the run."""
    recent = tried.where(F.col("tried_at") > F.lit(run - dt.timedelta(days=days))).select("slug").distinct()
    return names.withColumn("slug", slugify(F.col(name))).join(recent, "slug", "left_anti").drop("slug")


def link(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Fill company_id where it is null and the name is equal."""
    known = companies.groupBy("name").agg(F.min("id").alias("__id"))
    return jobs.join(known, F.col("company") == F.col("name"), "left").withColumn("company_id", F.coalesce("company_id", "__id")).drop("__id", "name")


def resolve(url: Column, page: Column, probed: Column) -> Column:
    """A board from the address itself, else from the page behind it, else from a probe; an address that is a URL is never probed."""
    return F.coalesce(detect_board(url), detect_board(page), F.when(~url.rlike("^https?://"), probed))


def looks_like_postings(payload: Column) -> Column:
    """A non-empty JSON list whose first element has a title, text or name."""
    keys = F.json_object_keys(F.get_json_object(payload, "$[0]"))
    return F.coalesce(F.arrays_overlap(keys, F.array(F.lit("title"), F.lit("text"), F.lit("name"))), F.lit(False))


def seed_rows(spark: SparkSession, boards: list[tuple[str, str, str]]) -> DataFrame:
    """(ats_type, ats_slug, name, status) rows of a list of boards, to be inserted where they are absent."""
    rows = F.array(*(F.struct(F.lit(a).alias("ats_type"), F.lit(s).alias("ats_slug"), F.lit(n).alias("name"), F.lit("active").alias("status")) for a, s, n in boards))
    return spark.range(1).select(F.inline(rows))
