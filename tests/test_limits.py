"""Nothing depends on a number of variants, recipes or a width of ids; gaps are reported, not passed over."""

import math

import pytest
from pyspark.sql import functions as F

from expkit import config as C
from expkit.functions import columns as X
from expkit.operators import exposure as E


def chi2_tail(x: float, df: int) -> float:
    """By the recurrence Q(df + 2) = Q(df) + (x/2)^(df/2) e^(-x/2) / Gamma(df/2 + 1)."""
    q, k = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
    while k < df:
        q += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        k += 2
    return q


def test_chi_square_tail_for_any_degrees_of_freedom(spark):
    cases = [(x, k) for x in (0.3, 4.0, 25.0, 90.0) for k in (1, 2, 7, 8, 9, 10, 11, 25, 60, 99)]
    df = spark.createDataFrame(cases, "x double, k int").select("x", "k", X.chi2_sf("x", "k").alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(chi2_tail(r.x, r.k), rel=1e-9, abs=1e-14)


def test_srm_with_twelve_variants_and_without_a_p_value(spark):
    uneven = [(C.variant_label(chr(65 + i)), 9000 if i == 0 else 1000) for i in range(12)]
    counts = spark.createDataFrame(uneven, "VARIANT_ID string, N bigint")
    row = E.srm_verdict(E.srm_pvalue(counts, "N")).first()
    assert row.DF == 11 and row.P_VALUE == 0.0 and row.SRM == "MISMATCH"
    even = spark.createDataFrame([(v, 1000) for v, _ in uneven], "VARIANT_ID string, N bigint")
    assert E.srm_verdict(E.srm_pvalue(even, "N")).first().SRM == "OK"
    alone = spark.createDataFrame(uneven[:1], "VARIANT_ID string, N bigint")
    assert E.srm_verdict(E.srm_pvalue(alone, "N")).first().SRM == "UNKNOWN"


def test_recipes_of_any_number_have_a_variant(spark):
    df = spark.createDataFrame([(f"1:2:0,777:{k}:0",) for k in (0, 1, 8, 11, 25, 26)] + [("778:1:0",), (None,)], "t string")
    got = [r.v for r in df.select(E.tnt_variant(F.col("t"), "777").alias("v")).collect()]
    assert got == ["VARIANT A", "VARIANT B", "VARIANT I", "VARIANT L", "VARIANT Z", "VARIANT AA", None, None]
    two = [r.v for r in df.select(E.tnt_variant(F.col("t"), "777", two_controls=True).alias("v")).collect()]
    assert two[:4] == ["VARIANT A", "VARIANT A", "VARIANT H", "VARIANT K"]


def test_rows_without_a_variant_are_counted(spark, sf_dir):
    from expkit.plans.catalog import engine_run

    df = spark.createDataFrame([(c,) for c in ("A", "G", "H", "", None)], "c string")
    assert E.unmapped(df, "c", E.ENGINE_LETTERS).first().UNMAPPED_ROWS == 3
    run = engine_run(spark, sf_dir)
    rows = E.engine_events(run.d.session_events, run.cfg, run.cfg.event_zone).select("DECISION_ENGINE_VARIANT_CD").collect()
    assert run.unmapped() == sum(r[0] not in tuple("ABCDEFG") for r in rows) > 0


def test_platform_without_a_source_raises(spark, sf_dir):
    from expkit.plans.catalog import Run

    cfg = C.ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-01-02", platform="Push")
    with pytest.raises(NotImplementedError):
        Run(spark, sf_dir, cfg).raw_exposure()


def test_ids_beyond_32_bits(spark):
    df = spark.createDataFrame([("3000000000",), ("9000000000000000000",), ("x",)], "id string")
    assert [r.i for r in df.select(X.try_int("id").alias("i")).collect()] == [3000000000, 9000000000000000000, None]
