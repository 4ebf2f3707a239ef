"""Every query with an oracle against DuckDB on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from rasterloom.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{src}')")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x.isoformat() if isinstance(x, datetime.datetime) else x


def table(names, rows):
    """Rows in an order that the last digits of numbers do not change."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [[cell(r[i]) for i in order] for r in rows]
    return sorted(names), sorted(rows, key=lambda r: [str(x) for x in r if not isinstance(x, float)] + [f"{x:.2f}" for x in r if isinstance(x, float)])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    mine = table(got.columns, [tuple(r) for r in got.collect()])
    want = db.execute(catalogue.ORACLES[name])
    theirs = table([d[0] for d in want.description], want.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-5) if isinstance(y, float) else y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0
