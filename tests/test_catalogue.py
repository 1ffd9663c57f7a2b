"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cohortry.plans import catalogue, surfaces  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(text(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


def test_plans_push_filters_and_prune_columns(spark):
    plan = lambda n: catalogue.QUERIES[n](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    p = plan("exists_code_value")
    assert "EqualTo(o_orderstatus,F)" in p and "o_orderdate" not in p and p.count("orders.parquet") == 1
    assert plan("boolean_exists_one_pass").count("orders.parquet") == 1
    for name, fact in (("chained_search", "lineitem"), ("unfiltered_reference_semi", "lineitem"), ("with_semi_join", "customer")):
        text = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count({"lineitem": "l_shipdate", "customer": "c_name"}[fact]) <= 1, name
    assert plan("chained_search").count("lineitem.parquet") == 1 == plan("unfiltered_reference_semi").count("lineitem.parquet")
    assert "EqualTo(o_custkey,7)" in plan("reference_search")


def test_set_operators_shuffle_partial_results(spark):
    """A value's rows all go to one task: each value is shuffled once a task, not once a row."""
    lines = catalogue.QUERIES["relation_set_operators"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 2 and all("HashAggregate" in lines[i + 1] for i in exchanges) and not any("Join" in line for line in lines)
