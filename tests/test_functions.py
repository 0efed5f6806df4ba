"""Column functions against closed forms."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from expkit.functions import columns as X
from expkit.operators import stats as S

Z = [0.0, 0.1, 0.5, 1.0, 1.6448536, 1.959964, 2.5, 3.0, 5.0, 7.0, 7.5, 9.0, 12.0, -0.7, -2.2, -8.0]


def test_normal_tail_matches_erfc(spark):
    df = spark.createDataFrame([(z,) for z in Z], "z double")
    rows = df.select("z", X.normal_lower_tail_abs("z").alias("t"), X.normal_cdf("z").alias("c")).collect()
    for r in rows:
        exact = 0.5 * math.erfc(abs(r.z) / math.sqrt(2))
        assert r.t == pytest.approx(exact, rel=1e-8, abs=1e-300)
        assert r.c == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-8, abs=1e-300)


def test_normal_tail_sql_twin_equals_spark(spark):
    con = duckdb.connect()
    duck = {z: con.execute(f"SELECT {S.normal_tail_sql(repr(z))}").fetchone()[0] for z in Z}
    df = spark.createDataFrame([(z,) for z in Z], "z double")
    for r in df.select("z", X.normal_lower_tail_abs("z").alias("t")).collect():
        assert r.t == pytest.approx(duck[r.z], rel=1e-14, abs=1e-300)


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 3.84, 7.5, 20.0])
def test_chi2_sf_closed_forms(spark, x):
    df = spark.createDataFrame([(x, k) for k in range(1, 9)], "x double, k int")
    got = {r.k: r.p for r in df.select("k", X.chi2_sf("x", "k").alias("p")).collect()}
    assert got[1] == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-8)
    assert got[2] == pytest.approx(math.exp(-x / 2), rel=1e-12)
    assert got[4] == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
    # survival decreases with x and increases with df
    assert all(got[k] <= got[k + 1] + 1e-15 for k in range(1, 8))
    con = duckdb.connect()
    for k in range(1, 9):
        assert con.execute(f"SELECT {S.chi2_sf_sql(repr(x), str(k))}").fetchone()[0] == pytest.approx(got[k], rel=1e-12)


def test_normal_quantile():
    assert X.normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert X.normal_quantile(0.95) == pytest.approx(1.6448536269514722, rel=1e-12)
    assert X.normal_quantile(0.5) == pytest.approx(0.0, abs=1e-15)


def test_sunday_week_start(spark):
    days = [dt.date(2024, 1, 7), dt.date(2024, 1, 8), dt.date(2024, 1, 13), dt.date(2024, 1, 14)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.w for r in df.select(X.sunday_week_start("d").alias("w")).collect()]
    assert got == [dt.date(2024, 1, 7), dt.date(2024, 1, 7), dt.date(2024, 1, 7), dt.date(2024, 1, 14)]


def test_event_in_list_exact_codes(spark):
    df = spark.createDataFrame([("12",), ("112",), ("1,12",), ("200,112",), (None,), ("120",)], "l string")
    got = [r.m for r in df.select(X.event_in_list("l", "12").alias("m")).collect()]
    assert got == [True, False, True, False, False, False]


def test_num_key_normalises_and_rejects(spark):
    df = spark.createDataFrame([("000123",), ("123",), ("X123",), (None,)], "k string")
    got = [r.k for r in df.select(X.num_key("k").alias("k")).collect()]
    assert [None if g is None else int(g) for g in got] == [123, 123, None, None]


def test_safe_div_and_winsorize(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0, 0.0), (4.0, 2.0, 5.0, 3.0), (2.0, 4.0, 1.0, 3.0)], "a double, b double, x double, t double")
    rows = df.select(X.safe_div("a", "b").alias("d"), X.winsorize("x", "t").alias("w"),
                     X.winsorize("x", "t", enabled=False).alias("off")).collect()
    assert rows[0].d is None and rows[1].d == 2.0
    assert [r.w for r in rows] == [5.0, 3.0, 1.0]  # threshold 0 means no capping
    assert [r.off for r in rows] == [5.0, 5.0, 1.0]
