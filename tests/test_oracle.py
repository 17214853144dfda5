"""Differential test: every registered query vs its DuckDB oracle at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from growthlens.catalog import QUERIES
from growthlens.config import FIXTURES
from oracle.queries import statements
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
SQL = statements(FIXTURES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    sc, sk, sh = digest(df.columns, srows)
    oc, ok, oh = digest(ocols, orows)
    assert sc == oc
    assert len(srows) == len(orows)
    assert sh == oh, (set(sk) ^ set(ok))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "month" in df.columns
