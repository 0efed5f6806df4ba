"""Household days, and moments that a refresh adds day by day.

``household_days`` sums facts to one row per household and day, without any experiment.  ``suffix_sums`` turns these
into one row a household: its days, and its totals from each of them to the last.  "From exposure on" is then a look-up
in that row (``since_exposure``): two totals are subtracted, and no facts are joined, so any number of experiments share
one table.  A household has at most as many entries as the window has days, so no key is hot.

``changes`` lists what a day does to a unit: on its exposure day the unit enters with totals of zero; on each day with
facts its totals before that day leave and those after it enter.  Metrics are any expressions over totals, so caps,
indicators and products are included.  ``daily_states`` sums the signed metrics up by variant and day, in DECIMAL, which
is exact; ``as_of`` adds the days up.  A refresh computes the changes of its own days from the totals of the units that
are active on them (``totals_before``), and stores them with ``sinks.refresh_days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from expkit.config import ExperimentConfig
from expkit.operators.metrics import metric_exposure

#: Sums of a transaction day besides its orders: name -> column of the transactions.
TXN_SUMS = {"TOT_REVENUE": "REVENUE", "NUM_UNITS": "ITEMS", "TOT_SNAP": "SNAP_TENDER"}
TXN_MEASURES = ["NUM_ORDERS", *TXN_SUMS]
MONEY = "decimal(38,4)"


def household_days(txns: DataFrame, cfg: ExperimentConfig, location: str | None = None) -> DataFrame:
    """(HOUSEHOLD_ID, DAY, measures…) of the transactions in the window; an order is a distinct transaction of the day."""
    t = txns.where(F.col("HOUSEHOLD_ID").isNotNull() & F.col("TXN_DTE").between(F.lit(cfg.start).cast("date"), F.lit(cfg.end).cast("date")))
    if location:
        t = t.where(F.col("TXN_LOCATION") == location)
    # One row a transaction first, so that orders are counted without a distinct aggregate over the rows.
    per_txn = t.groupBy("HOUSEHOLD_ID", F.col("TXN_DTE").cast("date").alias("DAY"), "TXN_ID").agg(
        *[F.sum(column).alias(name) for name, column in TXN_SUMS.items()])
    return per_txn.groupBy("HOUSEHOLD_ID", "DAY").agg(
        F.count("TXN_ID").cast(MONEY).alias("NUM_ORDERS"), *[F.coalesce(F.sum(c), F.lit(0)).cast(MONEY).alias(c) for c in TXN_SUMS])


def suffix_sums(days: DataFrame, key: str = "HOUSEHOLD_ID", day: str = "DAY") -> DataFrame:
    """One row a key: DAYS, ascending, and FROM_DAY, the totals of each measure from that day to the last (one entry more: zero)."""
    measures = [c for c in days.columns if c not in (key, day)]
    zero = F.struct(*(F.lit(0).cast(MONEY).alias(m) for m in measures))
    entry = F.struct(F.col(day).alias("day"), F.struct(*(F.col(m).cast(MONEY).alias(m) for m in measures)).alias("own"))
    rows = days.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("rows"))

    def before(a: Column, r: Column) -> Column:
        total = F.struct(*((a[0][m] + r["own"][m]).cast(MONEY).alias(m) for m in measures))
        return F.concat(F.array(total), a)

    return rows.select(key, F.transform("rows", lambda r: r["day"]).alias("DAYS"),
                       F.aggregate(F.reverse("rows"), F.array(zero), before).alias("FROM_DAY"))


def since_exposure(E: DataFrame, sums: DataFrame, cfg: ExperimentConfig, key: str = "HOUSEHOLD_ID") -> DataFrame:
    """Every exposed unit with its totals from its exposure (or the start) to the end of the window, looked up."""
    E = metric_exposure(E)
    measures = sums.schema["FROM_DAY"].dataType.elementType.fieldNames()
    looked = E.join(sums.withColumnRenamed(key, "_of"), F.col(key) == F.col("_of"), "left")
    first = F.greatest(F.col("EXPOSURE_DATETIME").cast("date"), F.lit(cfg.start).cast("date"))
    at = {"_from": F.size(F.filter("DAYS", lambda d: d < first)), "_to": F.size(F.filter("DAYS", lambda d: d <= F.lit(cfg.end).cast("date")))}
    looked = looked.withColumns(at)

    def total(m: str) -> Column:
        return F.when(F.col("_to") > F.col("_from"), F.get("FROM_DAY", F.col("_from"))[m] - F.get("FROM_DAY", F.col("_to"))[m])

    return looked.select(*[F.col(c) for c in E.columns], *[F.coalesce(total(m), F.lit(0)).cast("bigint" if m == "NUM_ORDERS" else MONEY).alias(m) for m in measures])


# ---------------------------------------------------------------------------
# Day by day
# ---------------------------------------------------------------------------

def unit_days(E: DataFrame, days: DataFrame, cfg: ExperimentConfig, key: str = "HOUSEHOLD_ID") -> DataFrame:
    """(UNIT, VARIANT_ID, DAY, measures…): the household days of exposed units from their exposure to the end."""
    measures = [c for c in days.columns if c not in (key, "DAY")]
    units = metric_exposure(E).select(F.col(key).alias("UNIT"), "VARIANT_ID", F.col("EXPOSURE_DATETIME").cast("date").alias("_since"))
    met = units.join(days, (F.col("UNIT") == F.col(key)) & (F.col("DAY") >= F.col("_since")) & F.col("DAY").between(
        F.lit(cfg.start).cast("date"), F.lit(cfg.end).cast("date")))
    return met.select("UNIT", "VARIANT_ID", "DAY", *measures)


def running_units(active: DataFrame) -> DataFrame:
    """Unit days with the unit's totals before and after each: BEFORE and AFTER, structs of the measures."""
    measures = [c for c in active.columns if c not in ("UNIT", "VARIANT_ID", "DAY")]
    so_far = Window.partitionBy("UNIT", "VARIANT_ID").orderBy("DAY").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {f"_t_{m}": F.sum(m).over(so_far) for m in measures}
    return active.withColumns(totals).select(
        "UNIT", "VARIANT_ID", "DAY",
        F.struct(*((F.col(f"_t_{m}") - F.col(m)).cast(MONEY).alias(m) for m in measures)).alias("BEFORE"),
        F.struct(*(F.col(f"_t_{m}").cast(MONEY).alias(m) for m in measures)).alias("AFTER"))


def totals_before(running: DataFrame, active: DataFrame, first_day: str) -> DataFrame:
    """``running_units`` of the days from ``first_day`` on: the stored unit days before it give the totals to start from."""
    measures = [c for c in active.columns if c not in ("UNIT", "VARIANT_ID", "DAY")]
    cut = F.lit(first_day).cast("date")
    fresh = active.where(F.col("DAY") >= cut)
    known = running.where(F.col("DAY") < cut).join(fresh.select("UNIT", "VARIANT_ID").distinct(), ["UNIT", "VARIANT_ID"], "left_semi")
    known = known.groupBy("UNIT", "VARIANT_ID").agg(F.max_by("AFTER", "DAY").alias("_known"))
    added = running_units(fresh).join(known, ["UNIT", "VARIANT_ID"], "left")

    def moved(side: str) -> Column:
        return F.struct(*((F.col(side)[m] + F.coalesce(F.col("_known")[m], F.lit(0))).cast(MONEY).alias(m) for m in measures)).alias(side)

    return added.select("UNIT", "VARIANT_ID", "DAY", moved("BEFORE"), moved("AFTER"))


def entries(E: DataFrame, measures: list[str], first_day: str | None = None, key: str = "HOUSEHOLD_ID") -> DataFrame:
    """Units on their exposure days (from ``first_day`` on, where given), with totals of zero."""
    units = metric_exposure(E).where(F.col(key).isNotNull())
    if first_day:
        units = units.where(F.col("EXPOSURE_DATETIME").cast("date") >= F.lit(first_day).cast("date"))
    zero = F.struct(*(F.lit(0).cast(MONEY).alias(m) for m in measures))
    return units.select(F.col(key).alias("UNIT"), "VARIANT_ID", F.col("EXPOSURE_DATETIME").cast("date").alias("DAY"), zero.alias("AFTER"))


def changes(entered: DataFrame, running: DataFrame) -> DataFrame:
    """(VARIANT_ID, DAY, SIGN, measures…): totals that enter (1) and leave (-1) on each day."""
    one, less = F.lit(1).cast(MONEY), F.lit(-1).cast(MONEY)
    moves = F.explode(F.array(F.struct(less.alias("SIGN"), F.col("BEFORE").alias("T")), F.struct(one.alias("SIGN"), F.col("AFTER").alias("T"))))
    rows = running.select("VARIANT_ID", "DAY", moves.alias("m")).select("VARIANT_ID", "DAY", "m.SIGN", "m.T.*")
    return rows.unionByName(entered.select("VARIANT_ID", "DAY", one.alias("SIGN"), "AFTER.*"))


SUMS = ("N", "SX", "SXX", "SY", "SYY", "SXY")


def daily_states(moves: DataFrame, metrics: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(VARIANT_ID, DAY, METRIC, N, SX, SXX, SY, SYY, SXY): what each day adds to the sums of each metric (x, or x and y)."""
    args = ", ".join(f"'{name}', CAST({x} AS DECIMAL(18,4)), CAST({y or 'NULL'} AS DECIMAL(18,4))" for name, (x, y) in metrics.items())
    long = moves.selectExpr("VARIANT_ID", "DAY", "SIGN", f"stack({len(metrics)}, {args}) AS (METRIC, x, y)")
    sign = F.col("SIGN").cast("int")

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(sign > 0, x).otherwise(-x)), F.lit(0)).cast("decimal(38,8)")

    x, y = F.col("x"), F.col("y")
    return long.groupBy("VARIANT_ID", "DAY", "METRIC").agg(
        F.sum(F.when(x.isNotNull(), sign).otherwise(0)).cast("long").alias("N"), total(x).alias("SX"), total(x * x).alias("SXX"),
        total(y).alias("SY"), total(y * y).alias("SYY"), total(x * y).alias("SXY"))


def as_of(states: DataFrame) -> DataFrame:
    """Sums up to and including each day: one row a variant, metric and day with changes, with MEAN, SD, MEAN_Y, SD_Y and COV.

    The window runs over days of one variant and metric: a bounded number of rows.
    """
    so_far = Window.partitionBy("VARIANT_ID", "METRIC").orderBy("DAY").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = states.select("VARIANT_ID", "DAY", "METRIC", *(F.sum(c).over(so_far).alias(c) for c in SUMS))
    return run.select("VARIANT_ID", "DAY", "METRIC", "N", *moments_of_sums())


def moments_of_sums() -> list[Column]:
    """MEAN, SD, MEAN_Y, SD_Y and COV of a row of sums."""
    n = F.col("N").cast("double")
    known, several = F.col("N") > 0, F.col("N") > 1

    def spread(xy: str, x: str, y: str) -> Column:
        a, b, c = (F.col(v).cast("double") for v in (xy, x, y))
        return F.when(several, (a - b * c / n) / (n - 1))

    def root(v: Column) -> Column:
        return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))

    return [F.when(known, F.col("SX").cast("double") / n).alias("MEAN"), root(spread("SXX", "SX", "SX")).alias("SD"),
            F.when(known, F.col("SY").cast("double") / n).alias("MEAN_Y"), root(spread("SYY", "SY", "SY")).alias("SD_Y"),
            spread("SXY", "SX", "SY").alias("COV")]


#: Metrics kept day by day for transactions: (x, y).
TXN_METRICS: dict[str, tuple[str, str | None]] = {
    "revenue, orders": ("TOT_REVENUE", "NUM_ORDERS"),
    "units, orders": ("NUM_UNITS", "NUM_ORDERS"),
    "buyers": ("CASE WHEN NUM_ORDERS > 0 THEN 1 ELSE 0 END", None),
    "revenue of buyers": ("CASE WHEN TOT_REVENUE <> 0 THEN TOT_REVENUE END", None),
}


def txn_report(running: DataFrame) -> DataFrame:
    """One row a variant and day, from ``as_of`` over ``TXN_METRICS``."""
    def of(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("METRIC") == metric, F.col(column)))

    r = running.groupBy("VARIANT_ID", "DAY").agg(
        of("revenue, orders", "N").alias("VISITORS"),
        F.round(of("revenue, orders", "MEAN"), 6).alias("REVENUE_MEAN"), F.round(of("revenue, orders", "SD"), 6).alias("REVENUE_SD"),
        F.round(of("revenue, orders", "MEAN_Y"), 6).alias("ORDERS_MEAN"), F.round(of("revenue, orders", "SD_Y"), 6).alias("ORDERS_SD"),
        F.round(of("revenue, orders", "COV"), 6).alias("COV_REVENUE_ORDERS"),
        F.round(of("units, orders", "MEAN"), 6).alias("UNITS_MEAN"), F.round(of("units, orders", "SD"), 6).alias("UNITS_SD"),
        F.round(of("units, orders", "COV"), 6).alias("COV_UNITS_ORDERS"),
        F.round(of("buyers", "MEAN"), 6).alias("CVR"),
        F.round(of("revenue of buyers", "MEAN"), 6).alias("REVENUE_NONZERO_MEAN"), F.round(of("revenue of buyers", "SD"), 6).alias("REVENUE_NONZERO_SD"))
    return r
