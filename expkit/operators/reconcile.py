"""Validation and reconciliation operators.

Each returns a small DataFrame (a handful of rows); checks that must stop a
run are evaluated by the caller on that frame (``assert_covered``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expkit import config as C
from expkit.config import ExperimentConfig, RefreshWindow
from expkit.functions.columns import in_window

ALLOWED_REGISTERS = C.ECOMM_REGISTERS + C.STORE_REGISTERS


def _lines(txn_facts: DataFrame, w: RefreshWindow) -> DataFrame:
    return txn_facts.filter(in_window("TXN_DTE", w.start, w.end) & F.col("REV_DTL_SUBTYPE_ID").isin(*C.REV_DTL_SUBTYPES)
                            & (F.col("MISC_ITEM_QTY") == 0) & (F.col("DEPOSIT_ITEM_QTY") == 0))


def _net(c: str = "") -> F.Column:
    return F.col(c + "NET_AMT") + F.col(c + "MKDN_WOD_ALLOC_AMT") + F.col(c + "MKDN_POD_ALLOC_AMT")


def baseline(txn_facts: DataFrame, w: RefreshWindow) -> DataFrame:
    """Gross, net, gross − net and allocated markdown without the register filter."""
    return _lines(txn_facts, w).agg(
        F.sum("GROSS_AMT").cast("decimal(38,4)").alias("TOTAL_GROSS_AMT"),
        F.sum(_net()).cast("decimal(38,4)").alias("TOTAL_NET_SALES"),
        (F.sum("GROSS_AMT") - F.sum(_net())).cast("decimal(38,4)").alias("TOTAL_MARKDOWN_CALC"),
        F.sum(F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")).cast("decimal(38,4)").alias("ALLOCATED_MKDNS"),
    ).select(F.lit("BASELINE_NO_FILTERS").alias("SCENARIO"), "*")


def _per_txn(txn_facts: DataFrame, txn_header: DataFrame, w: RefreshWindow) -> DataFrame:
    tf = (_lines(txn_facts, w).groupBy("TXN_ID", "TXN_DTE")
          .agg(F.sum("GROSS_AMT").alias("GROSS_AMT"), F.sum(_net()).alias("NET_SALES")))
    h = txn_header.filter(F.col("TXN_HDR_SRC_CD") == 0).select(
        F.col("TXN_ID").alias("_h_txn"), F.col("TXN_DTE").alias("_h_dte"), "REGISTER_NBR")
    return tf.join(h, (tf["TXN_ID"] == h["_h_txn"]) & (tf["TXN_DTE"] == h["_h_dte"]))


def filtered(txn_facts: DataFrame, txn_header: DataFrame, w: RefreshWindow) -> DataFrame:
    """The same totals after the register allow-list."""
    j = _per_txn(txn_facts, txn_header, w).filter(F.col("REGISTER_NBR").isin(*ALLOWED_REGISTERS))
    return j.agg(F.sum("GROSS_AMT").cast("decimal(38,4)").alias("TOTAL_GROSS_AMT"),
                 F.sum("NET_SALES").cast("decimal(38,4)").alias("TOTAL_NET_SALES"),
                 (F.sum("GROSS_AMT") - F.sum("NET_SALES")).cast("decimal(38,4)").alias("TOTAL_MARKDOWN_CALC")
                 ).select(F.lit("FILTERED_REGISTERS").alias("SCENARIO"), "*")


def excluded(txn_facts: DataFrame, txn_header: DataFrame, w: RefreshWindow) -> DataFrame:
    """What the allow-list drops, per register, largest first."""
    j = _per_txn(txn_facts, txn_header, w).filter(~F.col("REGISTER_NBR").isin(*ALLOWED_REGISTERS))
    return (j.groupBy("REGISTER_NBR")
            .agg(F.count_distinct("_h_txn").alias("TXN_COUNT"),
                 F.sum("GROSS_AMT").cast("decimal(38,4)").alias("GROSS_AMT"),
                 (F.sum("GROSS_AMT") - F.sum("NET_SALES")).cast("decimal(38,4)").alias("TOTAL_MARKDOWN"))
            .orderBy(F.desc("GROSS_AMT")))


def one_scan(txn_facts: DataFrame, txn_header: DataFrame, w: RefreshWindow) -> DataFrame:
    """V01–V03 from one pass over the facts: totals of everything, of the allowed registers, and of each register left out.

    Transactions get the class of their register (none without a header), and one ``GROUPING SETS`` gives the registers,
    the classes and the grand total.  SCENARIO tells the rows apart; REGISTER_NBR is set for the registers left out.
    """
    per_txn = _lines(txn_facts, w).groupBy("TXN_ID", "TXN_DTE").agg(
        F.sum("GROSS_AMT").alias("GROSS_AMT"), F.sum(_net()).alias("NET_SALES"), F.sum(F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")).alias("ALLOCATED"))
    # A transaction has one header; should it have several, the first register counts and the totals stay whole.
    h = txn_header.filter(F.col("TXN_HDR_SRC_CD") == 0).groupBy(F.col("TXN_ID").alias("_h_txn"), F.col("TXN_DTE").alias("_h_dte")).agg(F.min("REGISTER_NBR").alias("REGISTER_NBR"))
    j = per_txn.join(h, (F.col("TXN_ID") == F.col("_h_txn")) & (F.col("TXN_DTE") == F.col("_h_dte")), "left")
    kind = F.when(F.col("_h_txn").isNull(), "NO_HEADER").when(F.col("REGISTER_NBR").isin(*ALLOWED_REGISTERS), "FILTERED_REGISTERS").otherwise("EXCLUDED_REGISTER")
    j = j.withColumn("KIND", kind).withColumn("OUTSIDE", F.when(kind == "EXCLUDED_REGISTER", F.col("REGISTER_NBR")))
    # Groups to tell apart: all (grouping id 3), a class (1), a register of the class that is left out (0).
    sets = j.groupingSets([["KIND", "OUTSIDE"], ["KIND"], []], "KIND", "OUTSIDE").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("TXN_COUNT"), F.sum("GROSS_AMT").cast("decimal(38,4)").alias("TOTAL_GROSS_AMT"),
        F.sum("NET_SALES").cast("decimal(38,4)").alias("TOTAL_NET_SALES"), (F.sum("GROSS_AMT") - F.sum("NET_SALES")).cast("decimal(38,4)").alias("TOTAL_MARKDOWN_CALC"),
        F.sum("ALLOCATED").cast("decimal(38,4)").alias("ALLOCATED_MKDNS"))
    wanted = (F.col("level") == 3) | ((F.col("level") == 1) & (F.col("KIND") == "FILTERED_REGISTERS")) | ((F.col("level") == 0) & (F.col("KIND") == "EXCLUDED_REGISTER"))
    return sets.where(wanted).select(
        F.when(F.col("level") == 3, "BASELINE_NO_FILTERS").otherwise(F.col("KIND")).alias("SCENARIO"), F.col("OUTSIDE").alias("REGISTER_NBR"),
        "TXN_COUNT", "TOTAL_GROSS_AMT", "TOTAL_NET_SALES", "TOTAL_MARKDOWN_CALC", "ALLOCATED_MKDNS")


def identity(combined_txns_md: DataFrame) -> DataFrame:
    """revenue = net sales + total markdown, and total markdown = −(markdown + allocations)."""
    a = combined_txns_md.agg(F.sum("REVENUE").alias("REVENUE"), F.sum("NET_SALES").alias("NET_SALES"),
                             F.sum("TOTAL_MARKDOWN").alias("TOTAL_MARKDOWN"), F.sum("COMBINED_MKDN").alias("COMBINED_MKDN"),
                             F.count(F.lit(1)).alias("TXNS"))
    return a.select(
        F.col("TXNS").cast("bigint").alias("TXNS"),
        F.col("REVENUE").cast("decimal(38,4)").alias("REVENUE"),
        F.col("NET_SALES").cast("decimal(38,4)").alias("NET_SALES"),
        F.col("TOTAL_MARKDOWN").cast("decimal(38,4)").alias("TOTAL_MARKDOWN"),
        (F.col("REVENUE") == F.col("NET_SALES") + F.col("TOTAL_MARKDOWN")).alias("IDENTITY_HOLDS"),
        (F.col("TOTAL_MARKDOWN") == -F.col("COMBINED_MKDN")).alias("COMBINED_MATCHES"))


def strategy_comparison(markdown_agg: DataFrame, redemption_agg: DataFrame) -> DataFrame:
    """Means per customer and variant: revenue less net sales (expected, both capped) against the derived,
    native and native + allocation markdown, with differences and % errors (0 when expected is 0), and the
    digital markdown of the redemptions for reference."""
    j = markdown_agg.join(redemption_agg.select("VARIANT_ID", F.col("MKDN_MEAN").alias("DIGITAL")), "VARIANT_ID", "left")
    expected = F.col("COMBINED_REVENUE_MEAN") - F.col("COMBINED_NET_SALES_MEAN")
    means = {"DERIVED": F.col("TOTAL_MARKDOWN_MEAN"), "NATIVE": -F.col("MKDN_AMT_MEAN"), "NATIVE_ALLOC": -F.col("COMBINED_MKDN_MEAN")}
    out = ["VARIANT_ID", F.col("COMBINED_REVENUE_MEAN").alias("REVENUE"), F.col("COMBINED_NET_SALES_MEAN").alias("NET_SALES"),
           F.round(expected, 6).alias("EXPECTED"), F.round("DIGITAL", 6).alias("DIGITAL")]
    for name, mean in means.items():
        out += [F.round(mean, 6).alias(name), F.round(mean - expected, 6).alias(f"{name}_DIFF"),
                F.round(F.when(expected == 0, 0.0).otherwise((mean - expected) / expected * 100), 4).alias(f"{name}_PCT_ERROR")]
    return j.select(*out)


def coverage(table: DataFrame, cfg: ExperimentConfig, date_col: str = "TXN_DTE") -> DataFrame:
    """first/last date of a metric table and whether it encloses the run window."""
    a = table.agg(F.min(date_col).alias("FIRST_DATE"), F.max(date_col).alias("LAST_DATE"))
    return a.withColumn("COVERED", (F.lit(cfg.start).cast("date") >= F.col("FIRST_DATE"))
                        & (F.lit(cfg.end).cast("date") <= F.col("LAST_DATE")))


def assert_covered(cov: DataFrame) -> None:
    """Stop the run when the metric tables do not cover the window (one-row check)."""
    row = cov.first()
    if row is None or not row["COVERED"]:
        raise RuntimeError(f"run dates exceed the metric data: {row}")


def row_count(df: DataFrame) -> DataFrame:
    """Row count and column count of a built table."""
    return df.agg(F.count(F.lit(1)).alias("ROWS")).withColumn("COLUMNS", F.lit(len(df.columns)).cast("bigint"))
