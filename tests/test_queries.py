"""Every query over the smallest tables against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from nearfold.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert got == rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
