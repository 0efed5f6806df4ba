"""Power analysis (R21): how long an experiment must run, and what it can detect by then.

From a year of visits and transactions: a household enters on the day of its first visit, and its revenue, orders and
margin add up from then on.  ``operators.daily`` keeps the moments of all households as of every day; week by week they
give the households seen so far (H), and mean and deviation of revenue per household (RPC), of the revenue of those who
bought (NZ RPC), of the share who bought (CVR) and of adjusted gross profit (AGP).  With H dealt to two equal variants
the least relative effect that a two-sided test at ``alpha`` finds with the wanted power is

    MDE % = 100 * (z(1 - alpha / 2) + z(power)) * 2 * SD / sqrt(n) / mean,   n the households (buyers for NZ RPC).

The duration powered on RPC (on AGP) is the first week in which its MDE is at most ``target`` per cent, the duration
powered on the deconstructed RPC the first in which those of CVR and NZ RPC both are; the last week of the year where none
is.  The year has 52 weeks, so everything after the daily moments is a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit.config import ExperimentConfig
from expkit.functions.columns import normal_quantile
from expkit.operators import daily as Y

WEEKS = 52
METRICS = {"rpc": ("TOT_REVENUE", None), "nz": ("CASE WHEN TOT_REVENUE <> 0 THEN TOT_REVENUE END", None),
           "cvr": ("CASE WHEN NUM_ORDERS > 0 THEN 1 ELSE 0 END", None), "agp": ("AGP", None)}


def household_days(txns: DataFrame, agp: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Orders, revenue and AGP per household and day."""
    t = Y.household_days(txns, cfg).select("HOUSEHOLD_ID", "DAY", "NUM_ORDERS", "TOT_REVENUE", F.lit(0).cast(Y.MONEY).alias("AGP"))
    a = agp.where(F.col("HOUSEHOLD_ID").isNotNull()).groupBy("HOUSEHOLD_ID", F.col("TXN_DTE").cast("date").alias("DAY")).agg(
        F.sum(F.col("AGP_TOT").cast(Y.MONEY)).cast(Y.MONEY).alias("AGP"))
    zero = F.lit(0).cast(Y.MONEY)
    both = t.unionByName(a.select("HOUSEHOLD_ID", "DAY", zero.alias("NUM_ORDERS"), zero.alias("TOT_REVENUE"), "AGP"))
    return both.groupBy("HOUSEHOLD_ID", "DAY").agg(*[F.sum(c).cast(Y.MONEY).alias(c) for c in ("NUM_ORDERS", "TOT_REVENUE", "AGP")])


def weekly_moments(visits: DataFrame, days: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """(WEEK, and of each metric n_, mean_ and sd_) as of the end of each week since the start."""
    first = visits.where(F.col("RETAIL_CUSTOMER_HHID_TXT").isNotNull()).groupBy(F.col("RETAIL_CUSTOMER_HHID_TXT").cast("bigint").alias("HOUSEHOLD_ID")).agg(
        F.min(F.to_date("VISIT_START_TS")).alias("EXPOSURE_DATETIME"))
    everyone = first.withColumn("VARIANT_ID", F.lit("ALL"))
    measures = ["NUM_ORDERS", "TOT_REVENUE", "AGP"]
    running = Y.running_units(Y.unit_days(everyone, days, cfg))
    by_day = Y.as_of(Y.daily_states(Y.changes(Y.entries(everyone, measures), running), METRICS))
    weeks = by_day.sparkSession.range(1, WEEKS + 1).select(F.col("id").cast("int").alias("WEEK"))
    last_day = F.date_add(F.lit(cfg.start).cast("date"), F.col("WEEK") * 7 - 1)
    # Some hundred days meet 52 weeks: the last state of each metric by the end of the week.
    seen = by_day.join(F.broadcast(weeks), F.col("DAY") <= last_day).groupBy("WEEK", "METRIC").agg(
        F.max_by(F.struct("N", "MEAN", "SD"), "DAY").alias("s"))
    return seen.groupBy("WEEK").agg(*[
        F.max(F.when(F.col("METRIC") == m, F.col(f"s.{c}"))).alias(f"{out}_{m}") for m in METRICS for c, out in (("N", "n"), ("MEAN", "mean"), ("SD", "sd"))])


def power_results(weekly: DataFrame, experiment_id: str, alpha: float, power: float = 0.8, target: float = 5.0) -> DataFrame:
    """One row with the ten power fields of the experiment."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)

    def mde(m: str) -> Column:
        return F.try_divide(100 * z * 2 * F.col(f"sd_{m}"), F.sqrt(F.col(f"n_{m}").cast("double")) * F.col(f"mean_{m}"))

    w = weekly.select("WEEK", F.col("n_rpc").alias("HOUSEHOLDS"), *(mde(m).alias(m) for m in METRICS))
    reached = {"RPC": F.col("rpc") <= target, "AGP": F.col("agp") <= target, "DECONSTRUCTED": (F.col("cvr") <= target) & (F.col("nz") <= target)}
    row = F.struct("WEEK", "HOUSEHOLDS", *METRICS)
    # The first week that reaches the target, or else the last there is.
    picked = w.agg(*[F.coalesce(F.min_by(row, F.when(c, F.col("WEEK"))), F.max_by(row, "WEEK")).alias(k) for k, c in reached.items()])
    found = picked.where(F.col("RPC").isNotNull())

    def rounded(c: str) -> Column:
        return F.round(F.col(c), 6)

    return found.select(
        F.lit(experiment_id).alias("EXPERIMENT_ID"),
        F.col("RPC.WEEK").alias("POWERED_ON_RPC_DURATION_IN_WEEKS"), F.col("RPC.HOUSEHOLDS").alias("POWERED_ON_RPC_HOUSEHOLDS"),
        rounded("RPC.rpc").alias("POWERED_ON_RPC_RPC_MDE_PCT"), rounded("AGP.agp").alias("POWERED_ON_AGP_AGP_MDE_PCT"),
        F.col("DECONSTRUCTED.WEEK").alias("POWERED_ON_DECONSTRUCTED_DURATION_IN_WEEKS"), F.col("DECONSTRUCTED.HOUSEHOLDS").alias("POWERED_ON_DECONSTRUCTED_HOUSEHOLDS"),
        rounded("DECONSTRUCTED.rpc").alias("POWERED_ON_DECONSTRUCTED_RPC_MDE_PCT"), rounded("DECONSTRUCTED.nz").alias("POWERED_ON_DECONSTRUCTED_NZ_RPC_MDE_PCT"),
        rounded("DECONSTRUCTED.cvr").alias("POWERED_ON_DECONSTRUCTED_CVR_MDE_PCT"), rounded("DECONSTRUCTED.agp").alias("POWERED_ON_DECONSTRUCTED_AGP_MDE_PCT"))
