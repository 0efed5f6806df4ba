"""Scorecard and reporting operators (R13–R23) on the long test-result frame.

The test frame has one row per (TEST_ID, VARIANT_ID); everything here is a
reshape (stack / pivot with an explicit value list, so no extra job to find
the pivot values) or a column expression.  The frames are tiny
(tests × variants), so nothing here shuffles data that grows with the facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expkit.config import CONTROL_VARIANT

STATS = ("MEAN", "ABSOLUTE_DELTA", "RELATIVE_DELTA", "P_VALUE")


def results_long(tests: DataFrame) -> DataFrame:
    """R16 input: (ROW_LABEL, TEST_ID, VALUE) with ROW_LABEL = variant, '<variant> Absolute Delta', …"""
    label = {"MEAN": "", "ABSOLUTE_DELTA": " Absolute Delta", "RELATIVE_DELTA": " Relative Delta", "P_VALUE": " P-Value"}
    args = ", ".join(f"'{label[s]}', {s}" for s in STATS)
    st = tests.selectExpr("TEST_ID", "VARIANT_ID", f"stack({len(STATS)}, {args}) AS (SUFFIX, VALUE)")
    st = st.filter(~((F.col("VARIANT_ID") == CONTROL_VARIANT) & (F.col("SUFFIX") != "")))
    row = F.when(F.col("VARIANT_ID") == CONTROL_VARIANT, F.lit("CONTROL")).otherwise(F.col("VARIANT_ID"))
    return st.select(F.concat(row, F.col("SUFFIX")).alias("ROW_LABEL"), "TEST_ID", "VALUE")


def results_wide(tests: DataFrame, registry) -> DataFrame:
    """One column per test, one row per variant and statistic (numeric)."""
    ids = [t.id for t in registry]
    return results_long(tests).groupBy("ROW_LABEL").pivot("TEST_ID", ids).agg(F.first("VALUE"))


def significance(tests: DataFrame, registry, alpha: float) -> DataFrame:
    """R20: 'positive' / 'negative' / 'neutral' per test and variant; reversed where lower is better,
    neutral for count-like tests."""
    spark = tests.sparkSession
    d = spark.createDataFrame([(t.id, t.direction) for t in registry], "TEST_ID string, DIRECTION string")
    j = tests.filter(F.col("VARIANT_ID") != CONTROL_VARIANT).join(F.broadcast(d), "TEST_ID")
    sig = F.col("P_VALUE") < alpha
    up = F.col("ABSOLUTE_DELTA") > 0
    good = F.when(F.col("DIRECTION") == "down", ~up).otherwise(up)
    signal = (F.when(F.col("DIRECTION") == "none", "neutral")
              .when(sig & good, "positive").when(sig & ~good, "negative").otherwise("neutral"))
    return j.select("TEST_ID", "VARIANT_ID", "RELATIVE_DELTA", "P_VALUE", signal.alias("SIGNAL"))


def _fmt(value: F.Column, cls: F.Column) -> F.Column:
    v = value.cast("double")
    return (F.when(v.isNull(), F.lit(None))
            .when(cls == "count", F.format_number(v, 0))
            .when(cls == "dollar", F.concat(F.lit("$"), F.format_number(v, 2)))
            .when(cls == "percent", F.concat(F.format_number(v, 2), F.lit("%")))
            .otherwise(F.format_number(v, 2)))


def formatted(tests: DataFrame, registry) -> DataFrame:
    """Display strings — mean by metric class, relative delta '±x.xx%', p-value 3 places."""
    spark = tests.sparkSession
    d = spark.createDataFrame([(t.id, t.title, t.display) for t in registry], "TEST_ID string, TITLE string, DISPLAY string")
    j = tests.join(F.broadcast(d), "TEST_ID")
    return j.select("TEST_ID", "TITLE", "VARIANT_ID",
                    _fmt(F.col("MEAN"), F.col("DISPLAY")).alias("MEAN_TEXT"),
                    F.when(F.col("RELATIVE_DELTA").isNotNull(),
                           F.concat(F.format_number("RELATIVE_DELTA", 2), F.lit("%"))).alias("RELATIVE_DELTA_TEXT"),
                    F.when(F.col("P_VALUE").isNotNull(), F.format_number("P_VALUE", 3)).alias("P_VALUE_TEXT"))


# AGP, revenue, conversion and net sales per customer.
KEY_METRICS = ("T05", "T03", "T18", "T06")


def key_metrics(tests: DataFrame, registry, alpha: float) -> DataFrame:
    """The four headline metrics per variant with their significance signal (at the run's α)."""
    s = significance(tests.filter(F.col("TEST_ID").isin(*KEY_METRICS)), registry, alpha)
    return s.select("TEST_ID", "VARIANT_ID", "RELATIVE_DELTA", "SIGNAL")


def run_header(spark, cfg, variants: DataFrame, output_location: str = "") -> DataFrame:
    """One-row description of the run."""
    v = variants.agg(F.concat_ws(", ", F.array_sort(F.collect_set("VARIANT_ID"))).alias("VARIANTS"))
    return v.select(F.lit(cfg.experiment_id).alias("EXPERIMENT_ID"), F.lit(cfg.start).alias("START_DATE"),
                    F.lit(cfg.end).alias("END_DATE"), F.lit(cfg.platform).alias("PLATFORM"),
                    F.lit(cfg.alpha).alias("SIGNIFICANCE"), F.lit(cfg.exposure_filter).alias("EXPOSURE_FILTER"),
                    F.lit("99th" if cfg.winsorize else "OFF").alias("WINSORIZATION"), "VARIANTS",
                    F.lit(", ".join(cfg.page_filter)).alias("PAGE_FILTER"), F.lit(", ".join(cfg.os_platforms)).alias("OS_PLATFORMS"),
                    F.lit(", ".join(cfg.excluded_banners)).alias("EXCLUDED_BANNERS"),
                    F.lit(output_location).alias("OUTPUT_LOCATION"))


# ---------------------------------------------------------------------------
# R01–R14 published tables
# ---------------------------------------------------------------------------
#
# A table reads one or more family aggregates (one row per variant); the first
# named is the base, the others are left-joined on the variant.  ``FAMILY.COLUMN``
# names a column of a family.  Shares are percentages, conversion rates fractions.

def _ratio(part: str, whole: str, scale: int = 1) -> str:
    return f"ROUND(CAST({part} AS DOUBLE) / NULLIF({whole}, 0){f' * {scale}' if scale != 1 else ''}, 6)"


def _same(family: str, *names: str) -> list[tuple[str, str]]:
    return [(n, f"{family}.{n}") for n in names]


def _by_type(family: str, pattern: str) -> list[tuple[str, str]]:
    return _same(family, *(pattern.format(t) for t in ("pd", "gr", "mf", "spd", "pzn", "sc")))


_ENGAGEMENT = [
    *_same("engagement", "VISITORS", "UNIQUE_HOUSEHOLDS"),
    ("AUTHENTICATED_RATE", _ratio("engagement.UNIQUE_HOUSEHOLDS", "engagement.VISITORS")),
    ("VISITS_TOTAL", "engagement.VISITS_TOTAL"), ("VISITS_PER_CUSTOMER", "engagement.VISITS_MEAN"),
    ("CART_ADDS_TOTAL", "engagement.CART_ADDS_TOTAL"), ("CART_ADDS_PER_CUSTOMER", "engagement.CART_ADDS_MEAN"),
    ("CART_ADDS_CVR", "engagement.CART_ADDS_CVR"),
    ("COUPON_CLIPS_TOTAL", "engagement.COUPON_CLIPS_TOTAL"), ("COUPON_CLIPS_PER_CUSTOMER", "engagement.COUPON_CLIPS_MEAN"),
    ("COUPON_CLIPS_CVR", "engagement.COUPON_CLIP_CVR"),
    ("SEARCHES_TOTAL", "engagement.SEARCHES_TOTAL"), ("SEARCHES_PER_CUSTOMER", "engagement.SEARCHES_MEAN"),
    ("SEARCHES_CVR", "engagement.SEARCHES_CVR"),
]
_MARGIN = [("MARGIN_TOTAL", "margin.MARGIN_TOTAL"), ("MARGIN_PER_CUSTOMER", "margin.MARGIN_MEAN")]
_AGP = [("AGP_TOTAL", "agp.AGP_TOTAL"), ("AGP_PER_CUSTOMER", "agp.AGP_MEAN"),
        ("NET_SALES_TOTAL", "agp.NET_SALES_TOTAL"), ("NET_SALES_PER_CUSTOMER", "agp.NET_SALES_MEAN")]
_ECOMM = [
    *_same("ecomm", "PURCHASING_CUSTOMERS", "ECOMM_UNITS_TOTAL"), ("ECOMM_TXNS_TOTAL", "ecomm.ECOMM_ORDERS_TOTAL"),
    *_same("ecomm", "ECOMM_REVENUE_TOTAL", "ECOMM_NET_SALES_TOTAL", "ECOMM_BNC_TOTAL"),
    ("ECOMM_BNC_CVR", _ratio("ecomm.ECOMM_BNC_TOTAL", "ecomm.VISITORS")),
    *_same("ecomm", "ECOMM_AOV", "ECOMM_UPO"), ("ECOMM_REVENUE_PER_CUSTOMER", "ecomm.ECOMM_RPV"),
    ("ECOMM_NONZERO_REVENUE_PER_CUSTOMER", "ecomm.ECOMM_REVENUE_NONZERO_MEAN"),
    ("ECOMM_NET_SALES_PER_CUSTOMER", "ecomm.ECOMM_NET_SALES_MEAN"),
    ("ECOMM_NONZERO_NET_SALES_PER_CUSTOMER", "ecomm.ECOMM_NET_SALES_NONZERO_MEAN"),
    ("UNIQUE_REDEEMERS_ECOMM", "ecomm.REDEEMING_COUNT_ECOMM"), *_same("ecomm", "ECOMM_REDEMPTIONS_TOTAL", "ECOMM_MKDN_TOTAL"),
    ("ECOMM_REDEMPTIONS_PER_CUSTOMER", "ecomm.ECOMM_REDEMPTIONS_MEAN"), ("ECOMM_MKDN_PER_CUSTOMER", "ecomm.ECOMM_MKDN_MEAN"),
    ("ECOMM_CVR", _ratio("ecomm.PURCHASING_CUSTOMERS", "ecomm.VISITORS")),
]
_STORE = [
    *_same("store", "PURCHASING_CUSTOMERS", "STORE_UNITS_TOTAL"), ("STORE_TXNS_TOTAL", "store.STORE_ORDERS_TOTAL"),
    *_same("store", "STORE_REVENUE_TOTAL", "STORE_AOV", "STORE_UPO"), ("STORE_REVENUE_PER_CUSTOMER", "store.STORE_REVENUE_MEAN"),
    ("STORE_NONZERO_REVENUE_PER_CUSTOMER", "store.STORE_REVENUE_NONZERO_MEAN"),
    ("UNIQUE_REDEEMERS_STORE", "store.REDEEMING_COUNT_STORE"), *_same("store", "STORE_REDEMPTIONS_TOTAL", "STORE_MKDN_TOTAL"),
]
_GAS = [
    ("PURCHASING_GAS_VISITORS", "gas.GAS_VISITORS"), ("GAS_TXNS_TOTAL", "gas.GAS_ORDERS_TOTAL"), *_same("gas", "GAS_REVENUE_TOTAL", "GAS_AOV"),
    ("GAS_REVENUE_PER_CUSTOMER", "gas.GAS_RPV"), ("GAS_MKDN_PER_CUSTOMER", "gas.GAS_MKDN_MEAN"), *_same("gas", "GAS_REWARD_REDEMPTIONS_TOTAL"),
]
_COMBINED = [
    ("COMBINED_REVENUE_TOTAL", "combined.COMBINED_REVENUE_TOTAL"), ("CVR", _ratio("combined.PURCHASING_CUSTOMERS", "combined.VISITORS")),
    ("COMBINED_REVENUE_PER_CUSTOMER", "combined.COMBINED_RPV"),
    ("COMBINED_NONZERO_REVENUE_PER_CUSTOMER", "combined.COMBINED_REVENUE_NONZERO_MEAN"),
    ("TXNS_TOTAL", "combined.COMBINED_ORDERS_TOTAL"), ("TXNS_PER_CUSTOMER", "combined.COMBINED_ORDERS_MEAN"),
    ("UNITS_TOTAL", "combined.COMBINED_UNITS_TOTAL"), ("UNITS_PER_CUSTOMER", "combined.COMBINED_UNITS_MEAN"),
    ("AOV", "combined.COMBINED_AOV"), ("UPO", "combined.COMBINED_UPO"),
]
_REDEMPTIONS = [("REDEMPTIONS_TOTAL", "redemptions.REDEMPTIONS_TOTAL"), ("REDEMPTIONS_PER_CUSTOMER", "redemptions.REDEMPTIONS_MEAN"),
                ("MKDN_TOTAL", "redemptions.MKDN_TOTAL"), ("MKDN_PER_CUSTOMER", "redemptions.MKDN_MEAN")]
_CATEGORY_MEANS = ("CATEGORIES_MEAN", "CATEGORIES_SD", "ITEMS_MEAN", "ITEMS_SD", "CATEGORY_DEPTH", "CD_COV_ITEMS_CATEGORIES")
_EVERY = {n: e for part in (_ENGAGEMENT, _COMBINED, _REDEMPTIONS, _ECOMM, _MARGIN, _AGP) for n, e in part} | {
    "CATEGORY_BREADTH": "ROUND(category.CATEGORIES_MEAN, 4)", "CATEGORY_DEPTH": "ROUND(category.CATEGORY_DEPTH, 4)"}


def _of(*names: str) -> list[tuple[str, str]]:
    return [(n, _EVERY[n]) for n in names]


TABLES: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "engagement": (("engagement",), [*_ENGAGEMENT, *_same("engagement", "UNITS_TOTAL", "ORDERS_TOTAL", "REVENUE_TOTAL", "AOV", "UPO", "RPV")]),
    "margin_agp": (("agp", "margin"), [("CUSTOMERS", "agp.VISITORS"), *_MARGIN, *_AGP]),
    "ecomm": (("ecomm",), _ECOMM),
    "store": (("store",), _STORE),
    "gas": (("gas",), _GAS),
    "combined": (("combined",), _COMBINED),
    "clips": (("clips",), [("UNIQUE_CLIPPING_HH", "clips.UNIQUE_CLIPPING_HH"),
                           ("SHARE_CLIPPING", _ratio("clips.UNIQUE_CLIPPING_HH", "clips.VISITORS", 100)),
                           ("CLIPS_TOTAL", "clips.CLIPS_TOTAL"), ("CLIPS_PER_CUSTOMER", "clips.CLIPS_MEAN"), *_by_type("clips", "{}_clips_TOTAL")]),
    "redemptions": (("redemptions", "bonus"), [
        ("UNIQUE_REDEEMERS", "redemptions.REDEEMING_COUNT_COMBINED"),
        ("SHARE_REDEEMING", _ratio("redemptions.REDEEMING_COUNT_COMBINED", "redemptions.VISITORS", 100)),
        *_REDEMPTIONS, *_by_type("redemptions", "{}_redemptions_TOTAL"),
        ("SHARE_BP_EARNING", _ratio("bonus.BP_EARNING_HOUSEHOLDS", "redemptions.VISITORS", 100)),
        *_same("bonus", "BONUS_POINTS_TOTAL", "ESTIMATED_MKDN_TOTAL")]),
    "markdown": (("redemptions", "ecomm", "store"), [
        ("MKDN_TOTAL", "redemptions.MKDN_TOTAL"), ("ECOMM_MKDN_TOTAL", "ecomm.ECOMM_MKDN_TOTAL"), ("STORE_MKDN_TOTAL", "store.STORE_MKDN_TOTAL"),
        *_by_type("redemptions", "{}_MKDN_TOTAL")]),
    "basket": (("basket", "combined"), [
        *_same("basket", "UNIQUE_BASKET_HEALTH_HH"),
        ("SHARE_BASKET_HEALTH_HH", _ratio("basket.UNIQUE_BASKET_HEALTH_HH", "basket.VISITORS", 100)),
        ("NET_BASKET_RATE_TOTAL", "basket.BASKET_RATE_TOTAL"), ("NET_BASKET_RATE_MEAN", "basket.BASKET_RATE_MEAN"),
        *_same("basket", "AB_RATE_TOTAL", "AB_RATE_MEAN", "DE_RATE_TOTAL", "DE_RATE_MEAN", "TOTAL_BASKET_HEALTH_TXNS"),
        ("SHARE_BASKET_TXNS", _ratio("basket.TOTAL_BASKET_HEALTH_TXNS", "combined.COMBINED_ORDERS_TOTAL", 100))]),
    "category": (("category",), [*_same("category", "VISITORS", "UNIQUE_HOUSEHOLDS", "CATEGORIES_TOTAL", "ITEMS_TOTAL"),
                                 *((c, f"ROUND(category.{c}, 4)") for c in _CATEGORY_MEANS)]),
    "account": (("account",), _same("account", "VISITORS", "UNIQUE_HOUSEHOLDS", "email_count", "phone_count", "reachablity_score",
                                    "fn_ln_count", "bday_count", "address_count", "health_score")),
    "output": (("engagement", "combined", "redemptions", "ecomm", "margin", "agp", "category"), _of(
        "VISITORS", "COMBINED_REVENUE_PER_CUSTOMER", "COMBINED_NONZERO_REVENUE_PER_CUSTOMER", "NET_SALES_PER_CUSTOMER",
        "ECOMM_REVENUE_PER_CUSTOMER", "MKDN_PER_CUSTOMER", "AGP_PER_CUSTOMER", "CVR", "AOV", "UPO", "TXNS_PER_CUSTOMER",
        "UNITS_PER_CUSTOMER", "VISITS_PER_CUSTOMER", "SEARCHES_PER_CUSTOMER", "CART_ADDS_PER_CUSTOMER", "COUPON_CLIPS_PER_CUSTOMER",
        "REDEMPTIONS_PER_CUSTOMER", "SEARCHES_CVR", "CART_ADDS_CVR", "COUPON_CLIPS_CVR", "VISITS_TOTAL", "SEARCHES_TOTAL",
        "CART_ADDS_TOTAL", "COUPON_CLIPS_TOTAL", "TXNS_TOTAL", "UNITS_TOTAL", "COMBINED_REVENUE_TOTAL", "NET_SALES_TOTAL",
        "MKDN_TOTAL", "REDEMPTIONS_TOTAL", "ECOMM_REVENUE_TOTAL", "ECOMM_MKDN_TOTAL", "ECOMM_REDEMPTIONS_TOTAL",
        "ECOMM_NONZERO_REVENUE_PER_CUSTOMER", "ECOMM_REDEMPTIONS_PER_CUSTOMER", "ECOMM_MKDN_PER_CUSTOMER", "ECOMM_CVR",
        "ECOMM_BNC_TOTAL", "ECOMM_BNC_CVR", "CATEGORY_BREADTH", "CATEGORY_DEPTH", "UNIQUE_HOUSEHOLDS", "AUTHENTICATED_RATE")),
    "summary": (("engagement", "combined", "redemptions", "margin", "agp"), _of(
        "UNIQUE_HOUSEHOLDS", "COMBINED_REVENUE_PER_CUSTOMER", "COMBINED_NONZERO_REVENUE_PER_CUSTOMER", "NET_SALES_PER_CUSTOMER", "CVR",
        "MKDN_PER_CUSTOMER", "AGP_PER_CUSTOMER", "TXNS_PER_CUSTOMER", "UNITS_PER_CUSTOMER", "VISITS_PER_CUSTOMER", "SEARCHES_PER_CUSTOMER",
        "CART_ADDS_PER_CUSTOMER", "COUPON_CLIPS_PER_CUSTOMER", "MARGIN_PER_CUSTOMER", "REDEMPTIONS_PER_CUSTOMER")),
}


def published_table(name: str, family) -> DataFrame:
    """One published table; ``family(name)`` gives a family's per-variant aggregate."""
    families, columns = TABLES[name]
    out = None
    for f in families:
        agg = family(f)
        one = agg.select("VARIANT_ID", F.struct(*(c for c in agg.columns if c != "VARIANT_ID")).alias(f))
        out = one if out is None else out.join(one, "VARIANT_ID", "left")
    return out.select("VARIANT_ID", *(F.expr(sql).alias(alias) for alias, sql in columns))


# The published scorecard in its order: (list, metric, test, format).
PUBLISHED_METRICS: tuple[tuple[str, str, str, str], ...] = (
    ("Transaction", "Customers", "T01", "count"),
    ("Transaction", "Total Revenue Per Customer", "T03", "dollar"),
    ("Transaction", "Non Zero Revenue RPC", "T04", "dollar"),
    ("Transaction", "Net Sales Per Customer", "T06", "dollar"),
    ("Ecomm", "Ecomm Revenue per Customer", "T52", "dollar"),
    ("Ecomm", "Ecomm Non Zero RPC", "T53", "dollar"),
    ("Transaction", "Markdown Per Customer", "T11", "dollar"),
    ("Transaction", "AGP Per Customer", "T05", "dollar"),
    ("Transaction", "CVR", "T18", "percent"),
    ("Transaction", "AOV", "T12", "dollar"),
    ("Transaction", "UPO", "T13", "decimal"),
    ("Transaction", "Transactions Per Customer", "T08", "decimal"),
    ("Transaction", "Units Per Customer", "T09", "decimal"),
    ("Transaction", "Category Breadth", "T37", "decimal"),
    ("Transaction", "Category Depth", "T38", "decimal"),
    ("Engagement", "Visits Per Customer", "T02", "decimal"),
    ("Engagement", "Searches Per Customer", "T16", "decimal"),
    ("Engagement", "Cart Adds", "T14", "decimal"),
    ("Engagement", "Coupon Clips Per Customer", "T15", "decimal"),
    ("Engagement", "Redemptions Per Customer", "T10", "decimal"),
    ("Engagement", "% of Customers who Search", "T20", "percent"),
    ("Engagement", "% of Customers who Add to Cart", "T17", "percent"),
    ("Engagement", "% of Customers who Clip", "T19", "percent"),
    ("Ecomm", "Redemptions Per Customer - Ecomm", "T29", "decimal"),
    ("Ecomm", "Ecomm Net Sales", "T63", "dollar"),
    ("Ecomm", "Ecomm Non Zero Net Sales", "T64", "dollar"),
    ("Ecomm", "Ecomm MKDN per Customer", "T60", "dollar"),
    ("Ecomm", "Ecomm CVR", "T54", "percent"),
    ("Ecomm", "Ecomm TXNs Per Customer", "T55", "decimal"),
    ("Ecomm", "Ecomm BNC", "T61", "count"),
    ("Ecomm", "Ecomm BNC CVR", "T62", "percent"),
)


def published_scorecard(tests: DataFrame) -> DataFrame:
    """The 31 named metrics, one row per variant and statistic (numbers)."""
    wide = results_long(tests).groupBy("ROW_LABEL").pivot("TEST_ID", [t for _, _, t, _ in PUBLISHED_METRICS]).agg(F.first("VALUE"))
    return wide.select("ROW_LABEL", *(F.col(t).alias(name) for _, name, t, _ in PUBLISHED_METRICS))


def published_scorecard_text(tests: DataFrame) -> DataFrame:
    """The same as display strings.  Means and absolute deltas by the metric's format, relative deltas with
    two decimals and a percent sign, p-values with three; thousands are parted in counts, decimals and dollars only.
    """
    def plain(v: F.Column, places: int) -> F.Column:
        return F.replace(F.format_number(v, places), F.lit(","), F.lit(""))

    label = F.col("ROW_LABEL")
    out = []
    for _, name, _, kind in PUBLISHED_METRICS:
        v = F.col(f"`{name}`").cast("double")
        shown = {"count": F.format_number(v, 0), "decimal": F.format_number(v, 2), "percent": F.concat(plain(v, 2), F.lit("%")),
                 "dollar": F.concat(F.lit("$"), F.format_number(v, 2))}[kind]
        out.append(F.when(v.isNull(), "").when(label.endswith("P-Value"), plain(v, 3))
                   .when(label.endswith("Relative Delta"), F.concat(plain(v, 2), F.lit("%"))).otherwise(shown).alias(name))
    return published_scorecard(tests).select("ROW_LABEL", *out)


def missing_metrics(tests: DataFrame) -> DataFrame:
    """For the three published lists, which metrics the run has produced a result for."""
    spark = tests.sparkSession
    listed = spark.createDataFrame([(c, m, t) for c, m, t, _ in PUBLISHED_METRICS], "CATEGORY string, METRIC string, TEST_ID string")
    made = tests.select("TEST_ID").distinct().withColumn("_made", F.lit(True))
    return listed.join(made, "TEST_ID", "left").select("CATEGORY", "METRIC", "TEST_ID", F.coalesce("_made", F.lit(False)).alias("PRESENT"))


# The power-analysis fields the scorecard displays.
POWER_FIELDS = (
    "POWERED_ON_RPC_DURATION_IN_WEEKS", "POWERED_ON_RPC_HOUSEHOLDS", "POWERED_ON_RPC_RPC_MDE_PCT",
    "POWERED_ON_AGP_AGP_MDE_PCT", "POWERED_ON_DECONSTRUCTED_DURATION_IN_WEEKS", "POWERED_ON_DECONSTRUCTED_HOUSEHOLDS",
    "POWERED_ON_DECONSTRUCTED_RPC_MDE_PCT", "POWERED_ON_DECONSTRUCTED_NZ_RPC_MDE_PCT",
    "POWERED_ON_DECONSTRUCTED_CVR_MDE_PCT", "POWERED_ON_DECONSTRUCTED_AGP_MDE_PCT",
)


def power_lookup(power_results: DataFrame, experiment_id: str) -> DataFrame:
    """The power-analysis row of the experiment (one row; ``FOUND`` false with NULL fields when absent).

    Several rows for one experiment are reduced deterministically (struct minimum) instead of taking an
    arbitrary first row.
    """
    fields = [c for c in POWER_FIELDS if c in power_results.columns]
    hit = (power_results.filter(F.col("EXPERIMENT_ID") == experiment_id)
           .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_r")))
    return hit.select(F.lit(experiment_id).alias("EXPERIMENT_ID"), (F.col("_n") > 0).alias("FOUND"),
                      *[F.col(f"_r.{c}").alias(c) for c in fields])
