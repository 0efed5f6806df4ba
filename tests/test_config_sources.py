"""Config validation, window resolution, routing and sinks."""

import datetime as dt
import os
import tempfile

import pytest

from expkit.config import ExperimentConfig, RefreshWindow
from expkit.sources.sinks import metric_table, write_csv_report, write_table


def test_refresh_window_defaults_and_validation():
    today = dt.date(2024, 5, 1)
    w = RefreshWindow.resolve("Power", today=today)
    assert (w.start, w.end) == ("2023-05-02", "2024-05-01")
    assert RefreshWindow.resolve("SAFE", today=today).start == "2024-02-01"
    with pytest.raises(ValueError):
        RefreshWindow.resolve("SAFE", experiment_id="X")          # id without dates
    with pytest.raises(ValueError):
        RefreshWindow.resolve("SAFE", start="2024-01-01")          # one date only
    with pytest.raises(ValueError):
        RefreshWindow.resolve("SAFE", start="2024-01-01", end="2024-02-01")  # dates without id
    with pytest.raises(ValueError):
        RefreshWindow.resolve("Attributes", start="2024-01-01", end="2024-02-01", experiment_id="X")
    w = RefreshWindow.resolve("SAFE", "2024-01-01", "2024-02-01", "EXP1")
    assert w.table_name("visit_order", "work") == metric_table("visit_order", "work", "EXP1") == "work.EXP_VISIT_ORDER_EXP1"
    assert RefreshWindow("a", "b").table_name("agp", "work") == metric_table("agp", "work") == "work.EXP_AGP"


def test_experiment_config_clamp_and_checks():
    cfg = ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-06-30")
    assert cfg.clamp_end(dt.date(2024, 6, 30)).end == "2024-06-29"
    assert cfg.clamp_end(dt.date(2024, 8, 1)).end == "2024-06-30"
    assert cfg.unit_col == "HOUSEHOLD_ID" and cfg.end_exclusive == "2024-07-01"
    assert ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-01-02", platform="Adobe").unit_col == "ADOBE_VISITOR_ID"
    with pytest.raises(ValueError):
        ExperimentConfig(experiment_id="x", start="2024-02-01", end="2024-01-01")
    with pytest.raises(ValueError):
        ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-01-02", platform="Fax")


def test_refresh_writes_the_table_that_the_analysis_reads(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS routing_test")
    w = RefreshWindow.resolve("SAFE", "2024-01-01", "2024-02-01", "E1")
    try:
        write_table(spark.range(3), w.table_name("agp", "routing_test"), as_table=True)
        assert spark.table(metric_table("agp", "routing_test", "E1")).count() == 3
    finally:
        spark.sql("DROP DATABASE routing_test CASCADE")
    with pytest.raises(ValueError):
        metric_table("no_such_kind", "routing_test")


def test_sinks_round_trip(spark):
    base = tempfile.mkdtemp(prefix="xk-sink-", dir="/tmp")
    df = spark.createDataFrame([("VARIANT A", 1.5), ("VARIANT B", 2.5)], "VARIANT_ID string, X double")
    write_table(df, os.path.join(base, "t"))
    assert spark.read.parquet(os.path.join(base, "t")).count() == 2
    write_csv_report(df, os.path.join(base, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(base, "csv")).count() == 2
    write_csv_report(spark.range(20_000), os.path.join(base, "big"))
    assert spark.read.option("header", True).csv(os.path.join(base, "big")).count() == 20_000


def test_power_lookup_found_and_missing(spark):
    from expkit.operators.scorecard import POWER_FIELDS, power_lookup

    cols = ", ".join(f"{c} double" for c in POWER_FIELDS)
    rows = [("EXP1",) + tuple(float(i) for i in range(10)), ("EXP1",) + tuple(float(i + 1) for i in range(10)),
            ("EXP2",) + tuple(0.5 for _ in range(10))]
    pr = spark.createDataFrame(rows, f"EXPERIMENT_ID string, {cols}")
    hit = power_lookup(pr, "EXP1").collect()
    assert len(hit) == 1 and hit[0].FOUND and hit[0].POWERED_ON_RPC_DURATION_IN_WEEKS == 0.0
    miss = power_lookup(pr, "NOPE").collect()
    assert len(miss) == 1 and not miss[0].FOUND and miss[0].POWERED_ON_RPC_HOUSEHOLDS is None


def test_bucketed_table_sink(spark):
    import uuid

    name = f"xk_bucket_{uuid.uuid4().hex[:8]}"
    df = spark.range(100).selectExpr("id % 10 AS HOUSEHOLD_ID", "id AS TXN_ID")
    write_table(df, name, as_table=True, bucket_by=(4, "HOUSEHOLD_ID"))
    t = spark.table(name)
    assert t.count() == 100
    plan = t.groupBy("HOUSEHOLD_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the bucketing is reused: no shuffle for a household aggregation
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        write_table(df, "/tmp/never-written", bucket_by=(4, "HOUSEHOLD_ID"))


def test_checkpoint_dir_taken_from_session(spark):
    from expkit.sources.session import ensure_checkpoint_dir

    current = spark.conf.get("spark.checkpoint.dir")
    assert current and ensure_checkpoint_dir(spark) == current  # an existing setting is used, never replaced
    assert spark.conf.get("spark.checkpoint.dir") == current
