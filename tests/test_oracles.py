"""Every registered query against its SQL, on the smallest tables; queries without SQL have to run and keep a schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from fieldlark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"rf_classifier", "lr_head", "gbm_classifier", "embedding_forest", "double_logistic_fit", "phenometrics"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert table(rows, df.columns) == table(want.fetchall(), list(want.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
