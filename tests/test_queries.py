"""Registered queries against their SQL, and checks of the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
QUICK = ["greedy_gap", "nearest_storey", "slab_storey", "is_external", "candidates", "threshold_extract", "model_total",
         "report_stories", "outside_area", "review_fold", "spatial_tree", "curve_smooth"]
NAMES = sorted(driver.queries()) if os.environ.get("AREAFLOW_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["slab_storey", "nearest_storey", "model_total", "align", "external_walls"])
def test_no_cartesian_product_and_no_python_rows(spark, name):
    plan = plan_of(driver.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_filter_reaches_the_scan(spark):
    plan = plan_of(driver.queries()["manual_factor"](spark, FOLDER))
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [IsNotNull(event_type)" in plan
    assert "value" not in plan.split("ReadSchema")[1].split(">")[0]
