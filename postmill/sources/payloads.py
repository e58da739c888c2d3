"""Reading payloads and taking records out of their envelopes, as raw JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import docx_to_markdown


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def resume_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of the text, Markdown and .docx files under a path; files of other kinds are not opened.

    Text is Markdown. What can't be read or has no text has a problem instead, so that one bad file doesn't end a run over many."""
    plain = spark.read.option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").text(path, wholetext=True)
    plain = plain.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.lit(None).cast("string").alias("problem"))
    office = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)
    office = office.select(F.col("_metadata.file_path").alias("path"), docx_to_markdown("content").alias("r")).select("path", "r.*")
    rows = plain.unionByName(office)
    problem = F.coalesce("problem", F.when(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S"), "empty résumé"))
    return rows.select("path", F.when(problem.isNull(), F.col("text")).alias("text"), problem.alias("problem"))


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of ``resume_files``; a problem is an error, raised when it is read."""
    refused = F.raise_error(F.concat_ws(": ", "problem", "path"))
    return resume_files(spark, path).select("path", F.when(F.col("problem").isNull(), F.col("text")).otherwise(refused).alias("text"))


def elements(payload: Column, envelope: str | None) -> Column:
    """Raw JSON of each element of the envelope's list, or of a bare list."""
    if envelope is None:
        return F.from_json(payload, "array<string>")
    return F.from_json(payload, f"{envelope} array<string>")[envelope]


def pages(payloads: DataFrame, envelope: str | None, source: str, page: str) -> DataFrame:
    """Records of numbered pages up to the first empty one; pages after a gap are not read."""
    n = F.coalesce(F.size(elements(F.col("payload"), envelope)), F.lit(0))
    sized = payloads.withColumn("__n", n)
    first_empty = sized.where("__n <= 0").groupBy(source).agg(F.min(page).alias("__stop"))
    return sized.join(first_empty, source, "left").where(F.col("__stop").isNull() | (F.col(page) < F.col("__stop"))).drop("__n", "__stop")


def write_frozen(rows: DataFrame, path: str) -> None:
    """A JSON worksheet that is never overwritten."""
    rows.write.mode("errorifexists").json(path)
