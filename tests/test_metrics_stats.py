"""Metric attachment, winsorization and the hypothesis tests on hand-made frames."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from expkit import config as C
from expkit.operators import metrics as M
from expkit.operators import stats as S

CFG = C.ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-01-31", platform="Decision Engine")
D = dt.date


def test_attach_bounds_by_exposure_and_zero_fills(spark):
    E = spark.createDataFrame([(1, "VARIANT A", D(2024, 1, 10)), (2, "VARIANT B", D(2024, 1, 1)),
                               (None, "VARIANT A", D(2024, 1, 1))],
                              "HOUSEHOLD_ID bigint, VARIANT_ID string, EXPOSURE_DATETIME date")
    t = spark.createDataFrame([(1, 100, D(2024, 1, 9), "STORE", 5.0), (1, 101, D(2024, 1, 10), "STORE", 7.0),
                               (1, 102, D(2024, 1, 20), "ECOMM", 11.0), (3, 103, D(2024, 1, 5), "STORE", 13.0)],
                              "HOUSEHOLD_ID bigint, TXN_ID bigint, TXN_DTE date, TXN_LOCATION string, REVENUE double")
    t = t.select("*", F.col("REVENUE").cast("decimal(38,4)").alias("R"), F.lit(1).cast("decimal(38,4)").alias("ITEMS"),
                 F.lit(0).cast("decimal(38,4)").alias("SNAP_TENDER"), F.col("REVENUE").cast("decimal(38,4)").alias("NET_SALES")
                 ).drop("REVENUE").withColumnRenamed("R", "REVENUE")
    u = {(r.HOUSEHOLD_ID): r for r in M.txn_units(E, t, CFG, None).collect()}
    assert u[1].NUM_ORDERS == 2 and float(u[1].TOT_REVENUE) == 18.0  # purchase on the exposure day counts, before does not
    assert u[2].NUM_ORDERS == 0 and float(u[2].TOT_REVENUE) == 0.0
    assert u[None].NUM_ORDERS == 0  # units without household never match
    s = u[1]
    assert float(s._WIN_REV) == 18.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1e6, allow_nan=False), min_size=3, max_size=40))
def test_winsorized_mean_not_above_raw(spark, values):
    rows = [(i, "VARIANT A" if i % 2 else "VARIANT B", v) for i, v in enumerate(values)]
    u = spark.createDataFrame(rows, "HOUSEHOLD_ID bigint, VARIANT_ID string, TOT_REVENUE double")
    u = u.withColumn("TOT_REVENUE", F.col("TOT_REVENUE").cast("decimal(38,4)"))
    u = M.with_threshold(u, {"_WIN_REV": "TOT_REVENUE"}, CFG)
    capped = [a for a in M.txn_specs(CFG, "X") if a.name in ("X_REVENUE_TOTAL",)]
    raw = u.groupBy("VARIANT_ID").agg(F.sum("TOT_REVENUE").cast("double").alias("raw"))
    got = M.aggregate(u, capped).join(raw, "VARIANT_ID").collect()
    for r in got:
        assert float(r.X_REVENUE_TOTAL) <= r.raw + 1e-6


def _moments(spark, rows):
    return spark.createDataFrame(rows, "TEST_ID string, VARIANT_ID string, TEST_TYPE string, POOLED boolean, "
                                       "N bigint, M1 double, S1 double, M2 double, S2 double, COV double")


def test_welch_mean(spark):
    m = _moments(spark, [("t", "VARIANT A", "mean", False, 100, 10.0, 2.0, None, None, None),
                         ("t", "VARIANT B", "mean", False, 200, 10.5, 3.0, None, None, None)])
    r = [x for x in S.compare(m, 0.05).collect() if x.VARIANT_ID == "VARIANT B"][0]
    se = math.sqrt(4 / 100 + 9 / 200)
    z = 0.5 / se
    assert r.Z == pytest.approx(round(z, 6))
    assert r.P_VALUE == pytest.approx(round(math.erfc(z / math.sqrt(2)), 6))
    assert r.RELATIVE_DELTA == pytest.approx(5.0)
    assert r.CI_LOWER == pytest.approx(round(0.5 - 1.959963984540054 * se, 6))


def test_pooled_rate_reports_percent(spark):
    m = _moments(spark, [("r", "VARIANT A", "rate", True, 1000, 100.0, None, None, None, None),
                         ("r", "VARIANT B", "rate", True, 1000, 130.0, None, None, None, None)])
    out = {x.VARIANT_ID: x for x in S.compare(m, 0.1).collect()}
    p = 230 / 2000
    se = math.sqrt(p * (1 - p) * (2 / 1000))
    assert out["VARIANT A"].MEAN == pytest.approx(10.0) and out["VARIANT A"].P_VALUE is None
    assert out["VARIANT B"].Z == pytest.approx(round(0.03 / se, 6))
    assert out["VARIANT B"].ABSOLUTE_DELTA == pytest.approx(3.0)


def test_ratio_delta_method(spark):
    a = (5.0, 2.0, 1.0, 0.5, 0.4)
    b = (6.0, 2.5, 1.2, 0.6, 0.5)
    m = _moments(spark, [("q", "VARIANT A", "ratio", False, 400, a[0], a[1], a[2], a[3], a[4]),
                         ("q", "VARIANT B", "ratio", False, 500, b[0], b[1], b[2], b[3], b[4])])

    def var(mx, sx, my, sy, cov, n):
        return (sx ** 2 / my ** 2 + mx ** 2 * sy ** 2 / my ** 4 - 2 * mx * cov / my ** 3) / n

    se = math.sqrt(var(*a, 400) + var(*b, 500))
    r = [x for x in S.compare(m, 0.1).collect() if x.VARIANT_ID == "VARIANT B"][0]
    assert r.Z == pytest.approx(round((6 / 1.2 - 5 / 1.0) / se, 6), abs=2e-6)


def test_relabelling_variants_permutes_rows(spark):
    base = [("t", "VARIANT A", "mean", False, 50, 1.0, 1.0, None, None, None),
            ("t", "VARIANT B", "mean", False, 60, 1.3, 1.1, None, None, None),
            ("t", "VARIANT C", "mean", False, 70, 0.8, 0.9, None, None, None)]
    swapped = [r[:1] + ({"VARIANT B": "VARIANT C", "VARIANT C": "VARIANT B"}.get(r[1], r[1]),) + r[2:] for r in base]
    a = {r.VARIANT_ID: r.P_VALUE for r in S.compare(_moments(spark, base), 0.1).collect()}
    b = {r.VARIANT_ID: r.P_VALUE for r in S.compare(_moments(spark, swapped), 0.1).collect()}
    assert a["VARIANT B"] == b["VARIANT C"] and a["VARIANT C"] == b["VARIANT B"]
