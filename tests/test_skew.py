"""A household holding a third of all facts: the fact attachment is split by AQE's skew join and the
per-unit results stay exact."""

import datetime as dt

from pyspark.sql import functions as F

from expkit import config as C
from expkit.operators import metrics as M

CFG = C.ExperimentConfig(experiment_id="x", start="2024-01-01", end="2024-12-31", platform="Decision Engine")

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_household_is_split_and_exact(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        n_hot, n_other, households = 400000, 20, 2000
        E = (spark.range(households).select(F.col("id").alias("HOUSEHOLD_ID"),
                                            F.when(F.col("id") % 2 == 0, "VARIANT A").otherwise("VARIANT B").alias("VARIANT_ID"),
                                            F.lit(dt.date(2024, 1, 1)).alias("EXPOSURE_DATETIME")))
        # One fact table (a single scan, as in production) where household 0 holds most rows.
        facts = (spark.range(n_hot + households * n_other)
                 .select(F.when(F.col("id") < n_hot, F.lit(0)).otherwise(F.col("id") % households).alias("HOUSEHOLD_ID"),
                         F.col("id").alias("TXN_ID"), F.lit(dt.date(2024, 3, 1)).alias("TXN_DTE"),
                         F.lit(1).cast("decimal(38,4)").alias("REVENUE")))
        u = M.attach(E, facts, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
                     [F.count("TXN_ID").alias("N"), F.sum("REVENUE").alias("R")],
                     {"N": M._zero_l(), "R": M._zero_d()},
                     cond=lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"])
        rows = {r.HOUSEHOLD_ID: r.N for r in u.collect()}
        assert rows[0] == n_hot + n_other and rows[1] == n_other and len(rows) == households
        plan = u._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
