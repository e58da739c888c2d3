"""Evaluation of scores against labels, and draws that a seed fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lookups import covers, open_to_world, regions_named
from ..functions.text import any_word, let


def sweep(judged: DataFrame, score: str, relevant: str, top: int = 100, step: int = 5) -> DataFrame:
    """(threshold, hits, kept, relevant, precision, recall) at each threshold.

    Rows are first counted per step of the score, so that only the counts meet the thresholds."""
    cell = F.floor(F.col(score) / step) * step
    counts = judged.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col(relevant)).alias("k"))
    marks = judged.sparkSession.range(0, top + 1, step).select(F.col("id").alias("threshold"))
    out = F.broadcast(marks).crossJoin(counts).groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(F.col("cell") >= F.col("threshold"), F.col("k"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("cell") >= F.col("threshold"), F.col("n"))), F.lit(0)).alias("kept"), F.sum("k").alias("relevant"))
    return out.withColumns({"precision": F.try_divide("hits", "kept"), "recall": F.try_divide("hits", "relevant")})


def choose(swept: DataFrame, precision: float, recall: float, least: int) -> DataFrame:
    """The lowest threshold that clears both bars with enough kept rows."""
    return swept.where((F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.col("kept") >= least)).agg(F.min("threshold").alias("threshold"))


def with_pool(runs: DataFrame, run: str) -> DataFrame:
    """Runs, and all of them again as run 0."""
    return runs.unionByName(runs.withColumn(run, F.lit(0)))


def seeded(key: str, *salt) -> Column:
    return F.sha2(F.concat(F.lit(":".join(str(s) for s in salt) + ":"), F.col(key).cast("string")).cast("binary"), 256)


def shuffled(rows: DataFrame, key: str, seed: int, salt: str, most: int) -> DataFrame:
    """The first ``most`` of a shuffle, with their places; no more than that many reach one task."""
    top = rows.withColumn("__h", seeded(key, seed, salt)).orderBy("__h", key).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy("__h", key)).cast("bigint")).drop("__h")


def round_robin(rows: DataFrame, group: str, key: str, seed: int, most: int) -> DataFrame:
    """One of each group in turn, the rarest group first, until ``most`` are drawn."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(seeded(key, seed), key))
    return rows.withColumn("rn", rank).where(F.col("rn") <= most).join(sizes, group).orderBy("rn", "size", group).limit(most)


def skill_hits(title: Column, description: Column, skills: list[str], head: int = 4000) -> Column:
    """How many different skills a posting names as whole words, in its title or where its requirements stand."""
    text = F.concat_ws(" ", title, F.left(F.coalesce(description, F.lit("")), F.lit(head)))
    return reduce(lambda a, b: a + b, [any_word(text, [s]).cast("int") for s in dict.fromkeys(x.lower() for x in skills)], F.lit(0))


def on_craft(jobs: DataFrame, skills: list[str], key: str = "id", least: int = 2, cap: int = 2) -> DataFrame:
    """Postings that name ``least`` skills or more, most first: one per company and title, then ``cap`` per company."""
    hits = jobs.withColumn("hits", skill_hits(F.col("title"), F.col("description"), skills)).where(F.col("hits") >= least)
    order = [F.desc("hits"), F.col(key).cast("string")]
    first = hits.withColumn("__r", F.row_number().over(W.partitionBy("company", F.lower(F.trim("title"))).orderBy(*order))).where("__r = 1")
    return first.withColumn("__c", F.row_number().over(W.partitionBy("company").orderBy(*order))).where(F.col("__c") <= cap).drop("__r", "__c")


def reachable(places: Column, authorised: Column) -> Column:
    """Is a place one that the authorised regions are known to reach; without any authorised, every one is. Unlike a bar, unknown is no."""
    joined = F.array_join(places, " ")
    known = let(regions_named(joined), lambda wanted: open_to_world(joined, wanted) | ((F.size(wanted) > 0) & covers(authorised, wanted)))
    return (F.coalesce(F.size(authorised), F.lit(0)) <= 0) | F.coalesce(known, F.lit(False))


def capped(rows: DataFrame, role: list[str], group: str, cap: int, key: str, seed: int) -> DataFrame:
    """One row per role, then at most ``cap`` per group, in seeded order."""
    order = [seeded(key, seed), F.col(key)]
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(*role).orderBy(*order))).where("__r = 1")
    return first.withColumn("__c", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__c") <= cap).drop("__r", "__c")


def draw(strata: list[tuple[str, DataFrame]], key: str, seed: int, most: int) -> DataFrame:
    """(stratum, key): up to ``most`` of each stratum in turn, none drawn twice."""
    drawn: list[DataFrame] = []
    for name, rows in strata:
        left = rows.select(key)
        for before in drawn:
            left = left.join(before.select(key), key, "left_anti")
        drawn.append(left.orderBy(seeded(key, seed), key).limit(most).select(F.lit(name).alias("stratum"), key))
    return reduce(DataFrame.unionByName, drawn)
