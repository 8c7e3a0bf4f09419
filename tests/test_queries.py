"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gaugeworks.plans import registry, registry_runs  # noqa: F401  registers more queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "NULL"
    number = isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "-") in "iuf"
    return f"{float(v):.9g}" if number else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    a = registry.QUERIES[name](spark, DIR).toPandas()
    b = duck.sql(registry.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = [sorted(tuple(map(cell, r)) for r in x[columns].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_order(spark):
    rows = registry.QUERIES["metric_scan"](spark, DIR).collect()
    assert rows == sorted(rows, key=lambda r: (r["metric_name"], r["created_at"]))


def test_plans_have_no_python_and_prune(spark):
    for name in ("score_statistics", "accuracy_metrics", "compare_steps", "choice_shuffle"):
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    plan = registry.QUERIES["accuracy_metrics"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
