"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from turnledger.plans.oracles import ORACLE_SQL
from turnledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([value(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours.collect(), ours.columns) == plain(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
