"""Every core query with SQL against DuckDB on the smallest tables, by column names and values."""

import glob
import math
import os

import duckdb
import pytest

from factloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(SQL) == {"p5_found", "greedy_assignment"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, pushed",
    [("facts_since", "GreaterThanOrEqual(valid_at"), ("facts_current", "IsNull(expired_at)"), ("facts_held_after", "GreaterThan(invalid_at"), ("facts_citing", "EqualTo(kind,wiki)"), ("upsert_plan", "GreaterThanOrEqual(created_at"),
     ("facts_by_category", "EqualTo(category,business-logic)"), ("supersede_fold", "IsNotNull(superseded_by)"), ("excluded_paths", "EqualTo(kind,code)")],
)
def test_conditions_reach_the_scan(spark, name, pushed):
    assert pushed in plan(QUERIES[name](spark, SF)).split("PushedFilters", 1)[1]


@pytest.mark.parametrize("name", ["explain_rank", "episodes_latest", "fact_citations", "supersede_fold"])
def test_repeated_rows_cost_no_shuffle_of_the_table(spark, name):
    import re

    assert not re.search(r"hashpartitioning\(id#\d+,", plan(QUERIES[name](spark, SF)))


def test_hash_embedding_and_bootstrap_shuffle_no_rows(spark):
    assert plan(QUERIES["hash_embedding"](spark, SF)).count("Exchange") <= 1  # the distinct facts
    assert "Join" not in plan(QUERIES["bootstrap_ci"](spark, SF))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
