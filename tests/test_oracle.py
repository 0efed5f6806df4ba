"""Driver contract: every query equals its DuckDB oracle (row count, columns, value hash)."""

import pytest

import __spark_entry__ as entry_mod
from harness import compare, duck_connect

from expkit.plans.catalog import QUERIES as BASE

QUERIES = {k: v for k, v in entry_mod.queries().items() if k in BASE}
ORACLE = {k: v for k, v in entry_mod.oracle_sql().items() if k in BASE}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_connect(sf_dir)


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"TEST_ID", "VARIANT_ID", "MEAN", "P_VALUE"}


def test_every_query_has_oracle_or_is_display_only():
    missing = set(QUERIES) - set(ORACLE)
    assert not missing


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, con, name):
    r = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert r["ok"], r
