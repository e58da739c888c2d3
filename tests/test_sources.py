"""Sources whose descriptions are taken as they are, on documents without a text or with blanks only."""

import duckdb
import pytest
from pyspark.sql import functions as F

from postmill import plans
from postmill.sources import providers

from .test_queries import canon

TEXTS = ["", None, " ", "\n", "\t \n\n\n", "\x0b", "a\x0bb", " a ", "a b"]


@pytest.mark.parametrize("name", ["source_ashby", "source_aggregator"])
def test_documents_of_blanks_equal_the_sql(spark, tmp_path, name):
    rows = [(10 * at + k, t, "en", "src1") for at, t in enumerate(TEXTS) for k in (0, 1, 2, 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = plans.QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = canon(con.sql(f"SELECT {', '.join(cols)} FROM ({plans.ORACLES[name]})").fetchall())
    assert canon(got.select(*cols).collect()) == want and len(want) == 3 * len(TEXTS)


def test_the_aggregator_asks_for_a_title_that_may_be_blank(spark):
    record = lambda id, title, company="c": F.struct(F.lit(id).alias("id"), F.lit("s").alias("site"), F.lit("u").alias("job_url"), F.lit(title).alias("title"), F.lit(company).alias("company"))
    made = F.array(record("a", " "), record("b", ""), record("c", "t"), record("d", "t", " "))
    rows = spark.range(1).select(F.to_json(made).alias("payload"))
    ids = lambda *stated: [r["external_id"] for r in providers.normalize(rows, "aggregator", *stated).orderBy("external_id").collect()]
    assert ids() == ["jobspy:s:a", "jobspy:s:c"]
    assert ids(("site", "company", "job_url")) == ["jobspy:s:a", "jobspy:s:b", "jobspy:s:c"]
