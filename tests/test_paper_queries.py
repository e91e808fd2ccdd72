"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF

from papyrine.plans.queries import oracle_sql, queries

TABLES = "documents pages benchmark embeddings labels"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    want = db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
