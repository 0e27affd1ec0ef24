"""Every registered query against its independent DuckDB oracle on the smallest
tables (the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from casespark.plans.registry import all_queries
from oracles import all_sql
from tools.oracle_check import duck, rows_of

QUERIES = all_queries()          # the subpackage of training-data operators has its own tests
ORACLES = all_sql()


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, small_dir, con, key):
    sdf = QUERIES[key](spark, small_dir)
    srows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = rows_of(dcols, cur.fetchall())
    assert sorted(sdf.columns) == sorted(dcols)
    assert sorted(srows, key=repr) == sorted(drows, key=repr)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["disease", "patient_id", "draw_rank", "available", "sampled"]
