"""Every query against its DuckDB SQL on the smallest tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__
from postmill import plans

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def canon(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float, decimal.Decimal)):
            return f"{float(v):.9g}"
        return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v)

    return sorted("|".join(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({plans.ORACLES[name]})")
    assert sorted(duck.sql(plans.ORACLES[name]).columns) == cols
    assert canon(got.select(*cols).collect()) == canon(want.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_funnel_sums_to_the_pool(spark):
    from postmill.operators.filters import pool
    from postmill.plans.base import postings

    n = sum(r["n"] for r in plans.QUERIES["filter_funnel"](spark, SMALL).collect())
    assert n == pool(postings(spark, SMALL)).count()
