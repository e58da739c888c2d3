"""A corpus from documents to mixing rates, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns;
the last one adds tokens, domain posteriors and rates. Decisions are taken per doc_id: rows that
share an id go together, but for near duplicates, where the texts under one id are judged one by one and repeated
rows become one. Rows with a null doc_id can't be named and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.chosen_path import jaccard_classes
from postmill.llm.decontaminate import contamination
from postmill.llm.langid import fit_text_model, identify
from postmill.llm.secret_scan import find_secrets
from postmill.llm.shared import written
from postmill.llm.soft_mixing import mix_to_targets, quality_domains


def _without(docs: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """``docs`` without the ids of ``found``, which is worked out first: only ids then meet the documents."""
    return docs.join(written(found.select("doc_id").where("doc_id is not null").distinct(), what), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the label is the declared language, the source stands for the host.

    The text model is learnt from the same documents, so a document's own label counts in both."""
    found = identify(docs, fit_text_model(docs), "doc_id", "text", declared=F.col("lang"), host=F.col("source"))
    return _without(docs, found.where("rejected"), "rejected")


def _by_text(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, an integer for each different (doc_id, text): the id itself for the least text of an id by digest, and numbers
    above all ids for its other texts. Of rows of equal id and text, the one whose columns come first as JSON stays."""
    texts = docs.withColumn("__digest", F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    several = texts.join(repeated, "doc_id", "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = several.groupBy("doc_id", "__digest").agg(F.min_by(whole, F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("__whole"))
    one = written(one.withColumn("__more", F.monotonically_increasing_id()), "one-of-each")
    least = one.groupBy("doc_id").agg(F.min("__digest").alias("__least"))
    above = docs.agg(F.max("doc_id")).first()[0] + 1
    row = F.when(F.col("__digest") == F.col("__least"), F.col("doc_id")).otherwise(F.col("__more") + F.lit(above))
    ours = one.join(least, "doc_id").select(*(F.col("__whole")[c].alias(c) for c in docs.columns), row.alias("__row"))
    return docs.join(repeated, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns), F.col("doc_id").alias("__row")).unionByName(ours)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies; different texts under one id go by the class of each."""
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return _without(docs, jaccard_classes(docs).where("class_id <> doc_id"), "copies")
    rows = written(_by_text(docs, repeated), "rows")
    found = jaccard_classes(rows, "__row").where("class_id <> __row").select("__row")
    return rows.join(written(found, "copies"), "__row", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"), "contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret of any kind."""
    return _without(docs, find_secrets(docs).where("spans <> ''"), "secrets")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rates for the target mixture of domains."""
    return mix_to_targets(docs, quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mixing", mixing)]

#: SQL can't express the stages; tests/llm hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the documents; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
