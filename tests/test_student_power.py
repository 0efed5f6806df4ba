"""Student's t against published tables, and the choice of durations in the power analysis."""

import math

import pytest
from pyspark.sql import functions as F

from expkit.functions import columns as X
from expkit.operators import power as P
from expkit.operators import stats as S

# Two-sided 5 % points and others of Student's t as tabled to ten figures or known in closed form.
TABLED = [(12.70620473617471, 1, 0.05), (4.302652729911275, 2, 0.05), (2.570581835636314, 5, 0.05), (2.2281388519649385, 10, 0.05),
          (2.0422724563012373, 30, 0.05), (1.9839715184496334, 100, 0.05), (1.9623390808264074, 1000, 0.05), (3.169272672616951, 10, 0.01),
          (1.0, 1, 0.5), (0.0, 7, 1.0), (math.sqrt(2), 2, 2 * (0.5 - math.sqrt(2) / (2 * math.sqrt(4)))), (1e6, 1, 2 * math.atan(1e-6) / math.pi)]


def test_student_tails_equal_published_values(spark):
    df = spark.createDataFrame([(t, float(n), p) for t, n, p in TABLED], "t double, n double, p double")
    for r in df.withColumn("got", X.t_two_sided_p("t", "n")).withColumn("minus", X.t_two_sided_p(-F.col("t"), "n")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-8) and r.minus == r.got


def test_student_comes_near_the_normal_tail_with_many_units(spark):
    df = spark.createDataFrame([(0.1 * i, 1e6) for i in range(1, 60)], "t double, n double")
    for r in df.select(X.t_two_sided_p("t", "n").alias("a"), X.two_sided_p("t").alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=2e-6)


def test_beta_and_gamma(spark):
    df = spark.createDataFrame([(0.3, 2.0, 3.0), (0.9, 0.5, 0.5), (0.01, 40.0, 0.5), (0.999, 300.0, 0.5), (0.5, 7.5, 7.5)], "x double, a double, b double")
    for r in df.select("*", X.incomplete_beta("x", "a", "b").alias("i"), X.incomplete_beta(1 - F.col("x"), F.col("b"), F.col("a")).alias("j"), X.log_gamma("a").alias("g")).collect():
        assert r.i + r.j == pytest.approx(1, abs=1e-12) and r.g == pytest.approx(math.lgamma(r.a), abs=1e-10)
        n = 200_000
        mid = sum(((k + 0.5) / n * r.x) ** (r.a - 1) * (1 - (k + 0.5) / n * r.x) ** (r.b - 1) for k in range(n)) * r.x / n
        if r.a > 1:
            assert r.i == pytest.approx(mid * math.exp(math.lgamma(r.a + r.b) - math.lgamma(r.a) - math.lgamma(r.b)), abs=1e-6)


def test_welch_degrees_of_freedom(spark):
    rows = [("T", "VARIANT A", "mean", False, 8, 10.0, 2.0, None, None, None), ("T", "VARIANT B", "mean", False, 5, 13.0, 4.0, None, None, None),
            ("P", "VARIANT A", "mean", True, 8, 10.0, 2.0, None, None, None), ("P", "VARIANT B", "mean", True, 5, 13.0, 4.0, None, None, None),
            ("R", "VARIANT A", "rate", True, 80, 10.0, None, None, None, None), ("R", "VARIANT B", "rate", True, 50, 13.0, None, None, None, None)]
    m = spark.createDataFrame(rows, "TEST_ID string, VARIANT_ID string, TEST_TYPE string, POOLED boolean, N long, M1 double, S1 double, M2 double, S2 double, COV double")
    got = {r.TEST_ID: r.P_VALUE for r in S.compare(m, 0.1, student=True).where("VARIANT_ID = 'VARIANT B'").collect()}
    normal = {r.TEST_ID: r.P_VALUE for r in S.compare(m, 0.1).where("VARIANT_ID = 'VARIANT B'").collect()}
    a, b = 16 / 5, 4 / 8
    by_hand = spark.range(1).select(X.t_two_sided_p(F.lit(3 / math.sqrt(a + b)), F.lit((a + b) ** 2 / (a * a / 4 + b * b / 7))).alias("w"),
                                    X.t_two_sided_p(F.lit(3 / math.sqrt((4 * 16 + 7 * 4) / 11 * (1 / 5 + 1 / 8))), F.lit(11.0)).alias("p")).first()
    assert got["T"] == pytest.approx(by_hand.w, abs=1e-6) and got["P"] == pytest.approx(by_hand.p, abs=1e-6)
    assert got["T"] > normal["T"] and got["R"] == normal["R"]
    with pytest.raises(ValueError):
        S.compare(m, 0.1, one_tailed=True, student=True)


def test_durations_are_the_first_weeks_that_reach_the_target(spark):
    # MDE = 100 * z * 2 * sd / (sqrt(n) * mean): with sd = mean it falls with the square root of the households.
    z = X.normal_quantile(0.95) + X.normal_quantile(0.8)
    rows = [(w, *[v for k in (1.0, 2.0, 0.5, None) for v in ((100 * w, 10.0, 10.0 * k) if k else (100 * w, None, None))]) for w in (3, 1, 2, 50)]
    weekly = spark.createDataFrame(rows, "WEEK int, " + ", ".join(f"n_{m} long, mean_{m} double, sd_{m} double" for m in ("rpc", "nz", "cvr", "agp")))
    at = lambda w, k: 100 * z * 2 * k / math.sqrt(100 * w)
    r = P.power_results(weekly, "E", 0.1, target=at(2, 1.0) + 1e-9).first()
    assert (r.POWERED_ON_RPC_DURATION_IN_WEEKS, r.POWERED_ON_RPC_HOUSEHOLDS) == (2, 200) and r.POWERED_ON_RPC_RPC_MDE_PCT == pytest.approx(at(2, 1.0), abs=1e-5)
    assert r.POWERED_ON_DECONSTRUCTED_DURATION_IN_WEEKS == 50 and r.POWERED_ON_DECONSTRUCTED_CVR_MDE_PCT == pytest.approx(at(50, 0.5), abs=1e-5)
    assert r.POWERED_ON_AGP_AGP_MDE_PCT is None
    assert P.power_results(weekly, "E", 0.1, target=1e-9).first().POWERED_ON_RPC_DURATION_IN_WEEKS == 50
    assert P.power_results(weekly.limit(0), "E", 0.1).count() == 0
