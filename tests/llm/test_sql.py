"""Registered queries against their SQL at the smallest scale; the driver entry with the documents part."""

import duckdb
import pytest

import __spark_entry__ as driver
from areaflow.llm import registry
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = driver.queries()[name](spark, FOLDER).toPandas(), con.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_a_query_of_each_operator_is_registered():
    names = {n.split("_")[0] for n in registry.QUERIES}
    assert names == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert set(registry.QUERIES) <= set(driver.queries())
