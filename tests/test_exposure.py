"""Exposure operators on hand-made frames (edge rows of FIXTURES.md)."""

import datetime as dt

from expkit import config as C
from expkit.operators import exposure as X

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
SCHEMA = "HOUSEHOLD_ID bigint, VARIANT_ID string, EXPOSURE_DATETIME date"


def test_single_variant_drops_contaminated_keeps_null(spark):
    rows = [(1, "VARIANT A", D1), (1, "VARIANT B", D2), (2, "VARIANT A", D1), (2, "VARIANT A", D3),
            (None, "VARIANT B", D1), (None, "VARIANT A", D2), (3, None, D1)]
    out = X.single_variant(spark.createDataFrame(rows, SCHEMA)).collect()
    hh = sorted((r.HOUSEHOLD_ID is None, r.HOUSEHOLD_ID or 0) for r in out)
    assert (False, 1) not in hh
    assert hh.count((False, 2)) == 2 and hh.count((True, 0)) == 2
    assert (False, 3) not in hh  # only a NULL variant: COUNT(DISTINCT) is 0, not 1, so the household goes


def test_dedupe_households_first_exposure_then_variant_tiebreak(spark):
    rows = [(5, "VARIANT B", D2), (5, "VARIANT A", D2), (5, "VARIANT C", D3), (6, "VARIANT C", D1)]
    out = {r.HOUSEHOLD_ID: (r.VARIANT_ID, r.EXPOSURE_DATETIME) for r in X.dedupe_households(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {5: ("VARIANT A", D2), 6: ("VARIANT C", D1)}


def test_split_units(spark):
    schema = "HOUSEHOLD_ID bigint, ID string, ADOBE_VISITOR_ID string, VARIANT_ID string, EXPOSURE_DATETIME date"
    rows = [(1, "i1", "a1", "VARIANT A", D2), (1, "i2", "a2", "VARIANT A", D1),  # two visitors, one household
            (None, "i3", "a3", "VARIANT B", D3), (None, "i3", "a3", "VARIANT B", D1)]
    out = X.split_units(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 2
    byhh = {r.HOUSEHOLD_ID: r for r in out}
    assert byhh[1].ADOBE_VISITOR_ID == "a2" and byhh[None].EXPOSURE_DATETIME == D1


def test_third_party_exclusion_ignores_null_list_entries(spark):
    e = spark.createDataFrame([(1, "VARIANT A", D1), (2, "VARIANT B", D1), (None, "VARIANT A", D1)], SCHEMA)
    tp = spark.createDataFrame([(2,), (None,)], "HOUSEHOLD_ID bigint")
    got = sorted((r.HOUSEHOLD_ID is None, r.HOUSEHOLD_ID or 0) for r in X.exclude_third_party(e, tp).collect())
    assert got == [(False, 1), (True, 0)]


def test_web_exposure_backfills_household_and_takes_first_hit(spark):
    schema = ("DATE_TIME timestamp, DW_CREATETS timestamp, POST_VISID_HIGH string, POST_VISID_LOW string, "
              "POST_EVAR46 string, POST_EVAR47 string, POST_EVAR49 string, POST_TNT string, EXCLUDE_HIT string, HIT_SOURCE string")
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(t(1), t(1), "V", "1", "9", None, "A1", "777:1:0", "0", "1"),
            (t(2), t(2), "V", "1", "9", "42", "A1", "777:0:0", "0", "1"),
            (t(3), t(3), "V", "2", "9", None, "A2", "777:2:0", "0", "5")]  # excluded hit source
    cfg = C.ExperimentConfig(experiment_id="777", start="2024-01-01", end="2024-01-31", platform="Adobe")
    tp = spark.createDataFrame([], "HOUSEHOLD_ID bigint")
    out = X.exposure_web(spark.createDataFrame(rows, schema), tp, cfg).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.ADOBE_VISITOR_ID, r.VARIANT_ID, r.HOUSEHOLD_ID) == ("A1", "VARIANT B", 42)


def test_two_controls_mapping(spark):
    df = spark.createDataFrame([("x:1:0",), ("x:2:0",), ("x:0:0",)], "t string")
    got = [r.v for r in df.select(X.tnt_variant(df.t, "x", two_controls=True).alias("v")).collect()]
    assert got == ["VARIANT A", "VARIANT B", "VARIANT A"]


def test_srm_pvalue_equal_split_and_mismatch(spark):
    ok = spark.createDataFrame([("VARIANT A", 1000), ("VARIANT B", 1000)], "VARIANT_ID string, n long")
    bad = spark.createDataFrame([("VARIANT A", 1000), ("VARIANT B", 1200)], "VARIANT_ID string, n long")
    p_ok = X.srm_verdict(X.srm_pvalue(ok, "n")).first()
    p_bad = X.srm_verdict(X.srm_pvalue(bad, "n")).first()
    assert p_ok.P_VALUE == 1.0 and p_ok.SRM == "OK"
    assert p_bad.P_VALUE < 0.01 and p_bad.SRM == "MISMATCH"
