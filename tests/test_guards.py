"""Every stop of a checked run, custom household lists, exact quantiles and the one-scan reconciliation."""

import datetime
import math
import random
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from expkit.operators import exposure as X
from expkit.operators import reconcile as V
from expkit.operators.quantile import exact_quantiles
from expkit.plans import catalog
from expkit.sources.adapters import Domain

LATER = datetime.date(2030, 1, 1)


@pytest.fixture(scope="module")
def cfg(spark, sf_dir):
    """The engine experiment over dates that the transactions cover."""
    d = catalog.engine_run(spark, sf_dir)
    dates = d.combined_txns().agg(F.min("TXN_DTE").alias("a"), F.max("TXN_DTE").alias("b")).first()
    return replace(d.cfg, start=str(dates["a"])[:10], end=str(dates["b"])[:10])


def counts(spark, *n):
    return spark.createDataFrame([(f"VARIANT {chr(65 + i)}", x) for i, x in enumerate(n)], "VARIANT_ID string, HH_COUNT long")


def test_a_run_beyond_the_metric_data_stops(spark, sf_dir, cfg):
    with pytest.raises(RuntimeError, match="exceed"):
        catalog.Run.checked(spark, sf_dir, replace(cfg, start="1990-01-01"), LATER)
    with pytest.raises(RuntimeError, match="exceed"):
        catalog.Run.checked(spark, sf_dir, replace(cfg, end="2029-01-01"), LATER)


@pytest.mark.parametrize(("split", "stops"), [((900, 100), True), ((505, 495), False), ((700,), True)])
def test_a_split_that_is_off_or_unknown_stops(spark, sf_dir, cfg, monkeypatch, split, stops):
    monkeypatch.setattr(X, "variant_counts", lambda *_, **__: counts(spark, *split))
    if stops:
        with pytest.raises(RuntimeError, match="sample-ratio"):
            catalog.Run.checked(spark, sf_dir, cfg, LATER)
    assert catalog.Run.checked(spark, sf_dir, cfg, LATER, stop_on_mismatch=not stops).cfg.start == cfg.start


def test_the_end_lies_before_today(spark, sf_dir, cfg):
    today = datetime.date.fromisoformat(cfg.end) - datetime.timedelta(days=3)
    run = catalog.Run.checked(spark, sf_dir, cfg, today, stop_on_mismatch=False)
    assert run.cfg.end == str(today - datetime.timedelta(days=1))


def test_two_controls_are_noticed(spark, sf_dir, cfg, monkeypatch):
    for two in (True, False):
        monkeypatch.setattr(X, "has_two_controls", lambda *_, two=two: spark.range(1).select(F.lit(two).alias("TWO_CONTROLS")))
        assert catalog.Run.checked(spark, sf_dir, cfg, LATER, stop_on_mismatch=False).cfg.two_controls is two


def test_exposures_without_a_variant_are_counted(spark, sf_dir, cfg, monkeypatch):
    monkeypatch.setattr(catalog.Run, "unmapped", lambda self: 7)
    with pytest.warns(UserWarning, match="7 exposure rows"):
        catalog.Run.checked(spark, sf_dir, cfg, LATER, stop_on_mismatch=False)


def test_a_custom_list_keeps_its_households(spark, sf_dir, cfg):
    custom = replace(cfg, exposure_filter="Custom")
    with pytest.raises(ValueError):
        catalog.Run(spark, sf_dir, custom).exposure()
    every = [r.HOUSEHOLD_ID for r in catalog.Run(spark, sf_dir, cfg).exposure().collect() if r.HOUSEHOLD_ID is not None]
    some = sorted(every)[::3]
    listed = spark.createDataFrame([(h,) for h in [*some, *some, None, -1]], "HOUSEHOLD_ID long")
    got = catalog.Run(spark, sf_dir, custom, custom_households=listed).exposure()
    assert sorted(r.HOUSEHOLD_ID for r in got.collect()) == some


def by_hand(values, q):
    known = sorted(v for v in values if v is not None)
    return known[max(1, math.ceil(round(q * len(known), 9))) - 1] if known else None


@pytest.mark.parametrize("q", [0.99, 0.5, 0.0001, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(5)
    one = [Decimal(str(round(rng.expovariate(0.01), 4))) for _ in range(700)] + [None] * 20 + [Decimal("0")] * 300
    two = [Decimal(rng.choice([-(10**14), 10**14, 3, 3, 3])) for _ in one]
    rows = [(a, b, None, 5) for a, b in zip(one, two, strict=True)]
    df = spark.createDataFrame(rows, "a decimal(38,4), b decimal(38,0), c decimal(38,4), d int").repartition(5)
    got = exact_quantiles(df, {"A": "a", "B": "b", "C": "c", "D": "d"}, q)
    assert got == {"A": by_hand(one, q), "B": by_hand(two, q), "C": None, "D": 5}


def test_quantiles_refuse_what_they_cannot_count(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([(Decimal("0.00001"),)], "a decimal(38,5)"), {"A": "a"}, 0.5)
    with pytest.raises(ValueError):
        exact_quantiles(spark.range(3), {"A": "id"}, 0)
    assert exact_quantiles(spark.range(0), {"A": "id"}, 0.5) == {"A": None}


def test_one_scan_equals_the_three_reconciliations(spark, sf_dir):
    d = Domain(spark, sf_dir)
    one = V.one_scan(d.txn_facts, d.txn_header, catalog.WINDOW)
    rows = {(r.SCENARIO, r.REGISTER_NBR): r for r in one.collect()}
    base, kept = V.baseline(d.txn_facts, catalog.WINDOW).first(), V.filtered(d.txn_facts, d.txn_header, catalog.WINDOW).first()
    for want, r in ((base, rows["BASELINE_NO_FILTERS", None]), (kept, rows["FILTERED_REGISTERS", None])):
        assert all(r[c] == want[c] for c in want.asDict())
    out = V.excluded(d.txn_facts, d.txn_header, catalog.WINDOW).collect()
    assert {(r.REGISTER_NBR, r.TXN_COUNT, r.GROSS_AMT, r.TOTAL_MARKDOWN) for r in out} == {
        (k[1], r.TXN_COUNT, r.TOTAL_GROSS_AMT, r.TOTAL_MARKDOWN_CALC) for k, r in rows.items() if k[0] == "EXCLUDED_REGISTER"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("lineitem") <= d.txn_facts._jdf.queryExecution().optimizedPlan().toString().count("lineitem") + \
        d.txn_header._jdf.queryExecution().optimizedPlan().toString().count("lineitem")
