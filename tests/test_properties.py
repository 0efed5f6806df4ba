"""Whole-pipeline properties on the test tables."""

from pyspark.sql import functions as F

from expkit.plans import catalog


def test_combined_equals_ecomm_plus_store(spark, sf_dir):
    r = catalog.engine_run(spark, sf_dir)
    u = r.txn_shared()
    bad = u.filter((F.col("ALL_TOT_REVENUE") != F.col("ECOMM_TOT_REVENUE") + F.col("STORE_TOT_REVENUE"))
                   | (F.col("ALL_NUM_ORDERS") != F.col("ECOMM_NUM_ORDERS") + F.col("STORE_NUM_ORDERS"))
                   | (F.col("ALL_TOT_SNAP") != F.col("ECOMM_TOT_SNAP") + F.col("STORE_TOT_SNAP")))
    assert bad.count() == 0
    assert u.agg(F.sum("ALL_NUM_ORDERS")).first()[0] > 0


def test_redemption_totals_add_up(spark, sf_dir):
    r = catalog.engine_run(spark, sf_dir)
    u = r.red_shared()
    types = ["pd", "gr", "mf", "spd", "pzn", "sc"]
    s = sum(F.col(f"ALL_{t}_MKDN") for t in types)
    assert u.filter(F.col("ALL_total_mkdn") != s).count() == 0
    assert u.filter(F.col("ALL_total_mkdn") != F.col("ECOMM_total_mkdn") + F.col("STORE_total_mkdn")).count() == 0


def test_revenue_identity(spark, sf_dir):
    from expkit.plans.catalog import QUERIES

    row = QUERIES["recon_identity"](spark, sf_dir).first()
    assert row.IDENTITY_HOLDS and row.COMBINED_MATCHES


def test_every_exposed_unit_appears_once(spark, sf_dir):
    r = catalog.engine_run(spark, sf_dir)
    e = r.exposure()
    assert e.count() == e.select("HOUSEHOLD_ID").distinct().count()
    w = catalog.web_run(spark, sf_dir).exposure()
    assert w.filter(F.col("HOUSEHOLD_ID").isNotNull()).groupBy("HOUSEHOLD_ID").count().filter("count > 1").count() == 0
