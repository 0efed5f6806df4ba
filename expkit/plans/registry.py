"""Test registry (T01–T80) and the registry-driven test run.

Each published test is one row: which family aggregate it reads, the mean /
SD / covariance / sample-size columns, the test type and pooling.  A run
takes the mergeable moments of each family (``operators.moments``) that its tests
read, as one long frame, and hands them to ``stats.compare`` — one plan for all
tests instead of one code path per test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expkit.operators import builders as B
from expkit.operators import metrics as M
from expkit.operators import moments as Q
from expkit.operators import scorecard as R
from expkit.operators import stats as S


@dataclass(frozen=True)
class Test:
    id: str
    section: str
    title: str
    family: str
    mean: str           # column, or "A / B" for ratio tests
    sd: str | None      # column, or "SA / SB" for ratio tests
    cov: str | None
    n: str
    type: str           # mean | rate | ratio
    pooled: bool
    rounding: int
    direction: str = "up"   # up: higher is better; down: lower is better; none: no signal
    display: str = "decimal"  # count | decimal | dollar | percent


def _t(id, section, title, family, mean, sd, cov, n, type_, pooled, rnd, direction="up", display="decimal"):
    return Test(id, section, title, family, mean, sd, cov, n, type_, pooled, rnd, direction, display)


# The published tests of the analysis, in their published order.
TESTS: list[Test] = [
    _t("T01", "Summary Metrics", "Customers", "engagement", "VISITORS", "VISITS_SD", None, "VISITORS", "mean", False, 3, "none", "count"),
    _t("T02", "Summary Metrics", "Average Visits Per Customer", "engagement", "VISITS_MEAN", "VISITS_SD", None, "VISITORS", "mean", False, 3),
    _t("T03", "Summary Metrics", "Average Revenue Per Customer (RPC)", "combined", "COMBINED_REVENUE_MEAN", "COMBINED_REVENUE_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T04", "Summary Metrics", "Average Non-Zero Revenue Per Customer (RPC)", "combined", "COMBINED_REVENUE_NONZERO_MEAN", "COMBINED_REVENUE_NONZERO_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T05", "Summary Metrics", "Average AGP Per Customer", "agp", "AGP_MEAN", "AGP_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T06", "Summary Metrics", "Average Net Sales Per Customer", "agp", "NET_SALES_MEAN", "NET_SALES_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T07", "Summary Metrics", "Average Margin Per Customer", "margin", "MARGIN_MEAN", "MARGIN_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T08", "Summary Metrics", "Average TXNs Per Customer", "combined", "COMBINED_ORDERS_MEAN", "COMBINED_ORDERS_SD", None, "VISITORS", "mean", False, 4),
    _t("T09", "Summary Metrics", "Average Units Sold Per Customer", "combined", "COMBINED_UNITS_MEAN", "COMBINED_UNITS_SD", None, "VISITORS", "mean", False, 4),
    _t("T10", "Summary Metrics", "Total Redemptions Per Customer", "redemptions", "REDEMPTIONS_MEAN", "REDEMPTIONS_SD", None, "VISITORS", "mean", False, 3),
    _t("T11", "Summary Metrics", "Total Markdown Per Customer", "redemptions", "MKDN_MEAN", "MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T12", "Summary Metrics", "Average Order Value", "combined", "COMBINED_REVENUE_MEAN / COMBINED_ORDERS_MEAN", "COMBINED_REVENUE_SD / COMBINED_ORDERS_SD", "COMBINED_COV_REVENUE_ORDERS", "VISITORS", "ratio", False, 4, display="dollar"),
    _t("T13", "Summary Metrics", "Average Units Per Order (Basket Size)", "combined", "COMBINED_UNITS_MEAN / COMBINED_ORDERS_MEAN", "COMBINED_UNITS_SD / COMBINED_ORDERS_SD", "COMBINED_COV_UNITS_ORDERS", "VISITORS", "ratio", False, 4),
    _t("T14", "Engagement Metrics", "Average Cart Adds Per Customer", "engagement", "CART_ADDS_MEAN", "CART_ADDS_SD", None, "VISITORS", "mean", False, 4),
    _t("T15", "Engagement Metrics", "Coupon Clips Per Customer", "engagement", "COUPON_CLIPS_MEAN", "COUPON_CLIPS_SD", None, "VISITORS", "mean", False, 4),
    _t("T16", "Engagement Metrics", "Average Searches Per Customer", "engagement", "SEARCHES_MEAN", "SEARCHES_SD", None, "VISITORS", "mean", False, 4),
    _t("T17", "Engagement Metrics", "Add to Cart CVR", "engagement", "UNIQUE_USERS_THAT_ADDTOCART", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T18", "Engagement Metrics", "Transactions CVR", "combined", "PURCHASING_CUSTOMERS", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T19", "Engagement Metrics", "Coupon Clips CVR", "engagement", "UNIQUE_USERS_THAT_COUPON_CLIP", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T20", "Engagement Metrics", "Search CVR", "engagement", "UNIQUE_USERS_THAT_SEARCH", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T21", "Clips", "Total Clips (LOY_CLIPS)", "clips", "CLIPS_MEAN", "CLIPS_SD", None, "VISITORS", "mean", False, 3),
    _t("T22", "Clips", "Store Coupon Clips", "clips", "sc_clips_MEAN", "sc_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T23", "Clips", "Manufacturer Coupon Clips", "clips", "mf_clips_MEAN", "mf_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T24", "Clips", "Grocery Reward Clips", "clips", "gr_clips_MEAN", "gr_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T25", "Clips", "Personalized Deals Clips", "clips", "pd_clips_MEAN", "pd_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T26", "Clips", "Special-Personalized Deals Clips", "clips", "spd_clips_MEAN", "spd_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T27", "Clips", "PZN-Personalized Deals Clips", "clips", "pzn_clips_MEAN", "pzn_clips_SD", None, "VISITORS", "mean", False, 3),
    _t("T28", "Redemptions", "Unique Redeemers", "redemptions", "RPO_COMBINED_MEAN", "RPO_ECOMBINED_SD", None, "VISITORS", "mean", False, 3),
    _t("T29", "Redemptions", "Average Total Redemptions Per Customer Ecomm", "ecomm", "ECOMM_REDEMPTIONS_MEAN", "ECOMM_REDEMPTIONS_SD", None, "VISITORS", "mean", False, 3),
    _t("T30", "Redemptions", "Average Total Redemptions Per Customer In-Store", "store", "STORE_REDEMPTIONS_MEAN", "STORE_REDEMPTIONS_SD", None, "VISITORS", "mean", False, 3),
    _t("T31", "Redemptions", "Store Coupon Redemptions", "redemptions", "sc_redemptions_MEAN", "sc_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T32", "Redemptions", "Average Manufacturer Coupon Redemptions", "redemptions", "mf_redemptions_MEAN", "mf_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T33", "Redemptions", "Average Grocery Reward Redemptions", "redemptions", "gr_redemptions_MEAN", "gr_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T34", "Redemptions", "Average Personalized Deals Redemptions", "redemptions", "pd_redemptions_MEAN", "pd_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T35", "Redemptions", "Special-Personalized Deals Redemptions", "redemptions", "spd_redemptions_MEAN", "spd_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T36", "Redemptions", "PZN-Personalized Deals Redemptions", "redemptions", "pzn_redemptions_MEAN", "pzn_redemptions_SD", None, "VISITORS", "mean", False, 3),
    _t("T37", "Categories", "Categories Breadth Test", "category", "CATEGORIES_MEAN", "CATEGORIES_SD", None, "UNIQUE_HOUSEHOLDS", "mean", False, 4),
    _t("T38", "Categories", "Category Depth Test", "category", "ITEMS_MEAN / CATEGORIES_MEAN", "ITEMS_SD / CATEGORIES_SD", "CD_COV_ITEMS_CATEGORIES", "UNIQUE_HOUSEHOLDS", "ratio", False, 4),
    _t("T39", "Account Health", "E-mail Test", "account", "email_count", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T40", "Account Health", "Phone Test", "account", "phone_count", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T41", "Account Health", "Reachability Test", "account", "reachablity_score", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T42", "Account Health", "Name Fill Test", "account", "fn_ln_count", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T43", "Account Health", "Birth Date Test", "account", "bday_count", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T44", "Account Health", "Address Fill Test", "account", "address_count", None, None, "UNIQUE_HOUSEHOLDS", "rate", False, 4, display="percent"),
    _t("T45", "Account Health", "Health Score Test", "account", "health_score", "stdev_health_score", None, "UNIQUE_HOUSEHOLDS", "mean", False, 4),
    _t("T46", "Markdown", "Average Store Coupon Markdown Per Customer", "redemptions", "sc_MKDN_MEAN", "sc_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T47", "Markdown", "Average Manufacturer Coupon Markdown Per Customer", "redemptions", "mf_MKDN_MEAN", "mf_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T48", "Markdown", "Average Grocery Rewards Markdown Per Customer", "redemptions", "gr_MKDN_MEAN", "gr_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T49", "Markdown", "Average Personalized Deals Markdown Per Customer", "redemptions", "pd_MKDN_MEAN", "pd_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T50", "Markdown", "Average Special-Personalized Deals Markdown Per Customer", "redemptions", "spd_MKDN_MEAN", "spd_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T51", "Markdown", "Average PZN-Personalized Deals Markdown Per Customer", "redemptions", "pzn_MKDN_MEAN", "pzn_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T52", "Ecomm Metrics", "Ecomm Revenue Per Customer", "ecomm", "ECOMM_REVENUE_MEAN", "ECOMM_REVENUE_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T53", "Ecomm Metrics", "Ecomm Non-Zero Revenue Per Customer", "ecomm", "ECOMM_REVENUE_NONZERO_MEAN", "ECOMM_REVENUE_NONZERO_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T54", "Ecomm Metrics", "Ecomm Order CVR", "ecomm", "PURCHASING_CUSTOMERS", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T55", "Ecomm Metrics", "Ecomm TXNs Per Customer", "ecomm", "ECOMM_ORDERS_MEAN", "ECOMM_ORDERS_SD", None, "VISITORS", "mean", False, 3),
    _t("T56", "Ecomm Metrics", "Ecomm Units Per Customer", "ecomm", "ECOMM_UNITS_MEAN", "ECOMM_UNITS_SD", None, "VISITORS", "mean", False, 3),
    _t("T57", "Ecomm Metrics", "Ecomm Average Order Value (AOV)", "ecomm", "ECOMM_REVENUE_MEAN / ECOMM_ORDERS_MEAN", "ECOMM_REVENUE_SD / ECOMM_ORDERS_SD", "ECOMM_COV_REVENUE_ORDERS", "VISITORS", "ratio", False, 4, display="dollar"),
    _t("T58", "Ecomm Metrics", "ECOMM AOV", "ecomm", "ECOMM_REVENUE_NONZERO_MEAN / ECOMM_ORDERS_MEAN", "ECOMM_REVENUE_NONZERO_SD / ECOMM_ORDERS_SD", "ECOMM_COV_REVENUE_ORDERS", "VISITORS", "ratio", False, 4, display="dollar"),
    _t("T59", "Ecomm Metrics", "Ecomm Units Per Order (Basket Size)", "ecomm", "ECOMM_UNITS_MEAN / ECOMM_ORDERS_MEAN", "ECOMM_UNITS_SD / ECOMM_ORDERS_SD", "ECOMM_COV_UNITS_ORDERS", "VISITORS", "ratio", False, 4),
    _t("T60", "Ecomm Metrics", "E-Comm Average Markdown Per Customer", "ecomm", "ECOMM_MKDN_MEAN", "ECOMM_MKDN_SD", None, "VISITORS", "mean", True, 4, "down", "dollar"),
    _t("T61", "Ecomm Metrics", "E-Comm BNC Test", "ecomm", "ECOMM_BNC_TOTAL", "ECOMM_BNC_TOTAL_SD", None, "VISITORS", "mean", True, 4, "none", "count"),
    _t("T62", "Ecomm Metrics", "E-Comm BNC CVR Test", "ecomm", "ECOMM_BNC_TOTAL", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T63", "Ecomm Metrics", "Ecomm Net Sales Test", "ecomm", "ECOMM_NET_SALES_MEAN", "ECOMM_NET_SALES_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T64", "Ecomm Metrics", "Ecomm Non Zero Net Sales Test", "ecomm", "ECOMM_NET_SALES_NONZERO_MEAN", "ECOMM_NET_SALES_NONZERO_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T65", "In-Store Metrics", "In-Store Revenue Per Customer", "store", "STORE_REVENUE_MEAN", "STORE_REVENUE_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T66", "In-Store Metrics", "In-Store NonZero Revenue Per Customer", "store", "STORE_REVENUE_NONZERO_MEAN", "STORE_REVENUE_NONZERO_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T67", "In-Store Metrics", "In-Store Order CVR", "store", "PURCHASING_CUSTOMERS", None, None, "VISITORS", "rate", True, 4, display="percent"),
    _t("T68", "In-Store Metrics", "In-Store TXNs Per Customer", "store", "STORE_ORDERS_MEAN", "STORE_ORDERS_SD", None, "VISITORS", "mean", False, 3),
    _t("T69", "In-Store Metrics", "In-Store Average Units Sold Per Customer", "store", "STORE_UNITS_MEAN", "STORE_UNITS_SD", None, "VISITORS", "mean", False, 3),
    _t("T70", "In-Store Metrics", "In-Store Average Order Value (AOV)", "store", "STORE_REVENUE_MEAN / STORE_ORDERS_MEAN", "STORE_REVENUE_SD / STORE_ORDERS_SD", "STORE_COV_REVENUE_ORDERS", "VISITORS", "ratio", False, 4, display="dollar"),
    _t("T71", "In-Store Metrics", "IN-STORE AOV", "store", "STORE_REVENUE_NONZERO_MEAN / STORE_ORDERS_MEAN", "STORE_REVENUE_NONZERO_SD / STORE_ORDERS_SD", "STORE_COV_REVENUE_ORDERS", "VISITORS", "ratio", False, 4, display="dollar"),
    _t("T72", "In-Store Metrics", "In-Store Average Units Per Order (Basket Size)", "store", "STORE_UNITS_MEAN / STORE_ORDERS_MEAN", "STORE_UNITS_SD / STORE_ORDERS_SD", "STORE_COV_UNITS_ORDERS", "VISITORS", "ratio", False, 4),
    _t("T73", "In-Store Metrics", "In-Store Average Markdown Per Customer", "store", "STORE_MKDN_MEAN", "STORE_MKDN_SD", None, "VISITORS", "mean", True, 4, "down", "dollar"),
    _t("T74", "Basket Health", "Basket Health Mean Rate", "basket", "BASKET_RATE_MEAN", "BASKET_RATE_SD", None, "UNIQUE_BASKET_HEALTH_HH", "mean", False, 3),
    _t("T75", "Basket Health", "Basket Health (AB) Mean Rate", "basket", "AB_RATE_MEAN", "AB_RATE_SD", None, "UNIQUE_BASKET_HEALTH_HH", "mean", False, 3),
    _t("T76", "Basket Health", "Basket Health (DE) Mean Rate", "basket", "DE_RATE_MEAN", "DE_RATE_SD", None, "UNIQUE_BASKET_HEALTH_HH", "mean", False, 3, "down"),
    _t("T77", "SNAP Metrics", "Combined SNAP Tender Per Customer", "combined", "COMBINED_SNAP_MEAN", "COMBINED_SNAP_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T78", "Gas Metrics", "Gas Revenue Per Customer", "gas", "GAS_REVENUE_MEAN", "GAS_REVENUE_SD", None, "VISITORS", "mean", False, 3, display="dollar"),
    _t("T79", "Gas Metrics", "Gas Markdown", "gas", "GAS_MKDN_MEAN", "GAS_MKDN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
    _t("T80", "Markdown", "Total Markdown Per Customer (derived)", "markdown", "TOTAL_MARKDOWN_MEAN", "TOTAL_MARKDOWN_SD", None, "VISITORS", "mean", False, 3, "down", "dollar"),
]

FAMILIES = ("engagement", "combined", "agp", "margin", "redemptions", "clips", "ecomm", "store", "category",
            "account", "basket", "gas", "markdown")


def family_frames(run, family: str) -> list[tuple[DataFrame, list[M.Agg]]]:
    """Unit frames of a metric family for a ``catalog.Run``, each with its published columns."""
    E, cfg, d, w = run.exposure(), run.cfg, run.d, run.w
    if family == "engagement":
        # The visitor count of the published tests is the engagement frame's.
        return [(M.engagement_units(E, run.visit_order(), run.cart_coupon(), cfg), M.engagement_specs(cfg))]
    if family == "combined":
        return [(M.txn_units(E, run.combined_txns(), cfg, None, shared=run.txn_shared()), M.txn_specs(cfg, "COMBINED"))]
    if family == "agp":
        return [(M.agp_units(E, B.agp_daily(d, w), cfg), M.agp_specs(cfg))]
    if family == "margin":
        return [(M.margin_units(E, B.margin_weekly(d, w), cfg), M.margin_specs(cfg))]
    if family == "redemptions":
        return [(M.redemption_units(E, run.combined_txns(), run.redemptions(), cfg, None, shared=run.red_shared()), M.redemption_specs(cfg, None))]
    if family == "clips":
        return [(M.clip_units(E, B.clips(d, w), cfg), M.clip_specs(cfg))]
    if family in ("ecomm", "store"):
        loc = family.upper()
        bnc = B.first_ecomm(d, w) if loc == "ECOMM" else None
        return [(M.txn_units(E, run.combined_txns(), cfg, loc, bnc, shared=run.txn_shared()), M.txn_specs(cfg, loc, ecomm=loc == "ECOMM")),
                (M.redemption_units(E, run.combined_txns(), run.redemptions(), cfg, loc, shared=run.red_shared()), M.redemption_specs(cfg, loc))]
    if family == "category":
        return [(M.category_units(E, B.category_txns(d, w), cfg), M.category_specs(cfg))]
    if family == "account":
        return [(M.account_units(E, B.account_health(d, w)), M.account_specs(cfg))]
    if family == "basket":
        return [(M.basket_units(E, B.basket_health(d, w), cfg), M.basket_specs(cfg))]
    if family == "gas":
        return [(M.gas_units(E, B.gas_txns(d, w), cfg), M.gas_specs(cfg))]
    if family == "bonus":
        return [(M.bonus_units(E, M.bonus_points_daily(d.points_header, d.points, cfg)), M.bonus_specs(cfg))]
    if family == "markdown":
        return [(M.markdown_units(E, run.combined_txns_md(), cfg), M.markdown_specs(cfg))]
    raise KeyError(family)


def family_aggregate(run, family: str) -> DataFrame:
    """Per-variant aggregate of one metric family for a ``catalog.Run``: all its published columns."""
    frames = [M.aggregate(units, specs) for units, specs in family_frames(run, family)]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, "VARIANT_ID")
    return out


def _split(expr: str | None) -> tuple[str | None, str | None]:
    if expr is None:
        return None, None
    parts = [p.strip() for p in expr.split("/")]
    return (parts[0], parts[1]) if len(parts) == 2 else (parts[0], None)


def moments_sql_row(t: Test) -> str:
    """SELECT list (shared SQL) that turns one family-aggregate row into one moments row of test ``t``."""
    m1, m2 = _split(t.mean)
    s1, s2 = _split(t.sd)

    def d(x: str | None) -> str:
        return f"CAST({x} AS DOUBLE)" if x else "CAST(NULL AS DOUBLE)"

    return (f"'{t.id}' AS TEST_ID, VARIANT_ID, '{t.type}' AS TEST_TYPE, {str(t.pooled).upper()} AS POOLED, "
            f"CAST({t.n} AS BIGINT) AS N, {d(m1)} AS M1, {d(s1)} AS S1, {d(m2)} AS M2, {d(s2)} AS S2, {d(t.cov)} AS COV")


def _roles(t: Test) -> dict[str, str]:
    """Which published column stands for which number of a test."""
    m1, m2 = _split(t.mean)
    s1, s2 = _split(t.sd)
    return {k: v for k, v in {"N": t.n, "M1": m1, "S1": s1, "M2": m2, "S2": s2, "COV": t.cov}.items() if v}


#: Families whose frames can hold a unit on several rows, whatever the platform.
SEVERAL_ROWS = ("account",)


def states(run, tests: list[Test]) -> tuple[DataFrame, list[tuple]]:
    """(states, roles): the mergeable moments that the tests read, of all families as one long frame, and
    which of them, by name, stands for what: (METRIC, statistic, test id, role)."""
    frames, roles = [], []
    if len({t.family for t in tests}) > 1:
        run.share_facts()
    for fam in FAMILIES:
        own = [t for t in tests if t.family == fam]
        if not own:
            continue
        for i, (units, specs) in enumerate(family_frames(run, fam)):
            published = {a.name: a for a in specs}
            named: dict[tuple, str] = {}
            metrics = {}
            for t in own:
                for role, column in _roles(t).items():
                    if column not in published:
                        continue
                    m = Q.metric(published[column])
                    name = named.setdefault((m.x, m.y, m.unit), f"{fam}.{i}.{len(named)}")
                    metrics.setdefault(name, m)
                    roles.append((name, m.stat, t.id, role))
            if metrics:
                frames.append(Q.state(units, metrics, distinct_units=run.cfg.platform != "Adobe" and fam not in SEVERAL_ROWS))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out, roles


def moments(run, tests: list[Test] | None = None) -> DataFrame:
    """Long moments frame of all requested tests, from the states of their families.

    Each family's metrics are one ``stack`` and one ``groupBy``; what is left is some rows a metric and variant, which the
    registry's rows (at most one per test and role) turn into one row a test and variant.
    """
    tests = tests or TESTS
    long, roles = states(run, tests)
    kinds = {t.id: t for t in tests}
    rows = ", ".join(f"('{name}', '{stat}', '{test}', '{role}', '{kinds[test].type}', {str(kinds[test].pooled).upper()})"
                     for name, stat, test, role in roles)
    wanted = long.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS r(OF_METRIC, STAT, TEST_ID, ROLE, TEST_TYPE, POOLED)")
    value = Q.statistic(F.col("STAT"))
    met = long.join(F.broadcast(wanted), F.col("METRIC") == F.col("OF_METRIC")).withColumn("VALUE", value)
    out = met.groupBy("TEST_ID", "VARIANT_ID", "TEST_TYPE", "POOLED").agg(
        *[F.max(F.when(F.col("ROLE") == r, F.col("VALUE"))).alias(r) for r in ("N", "M1", "S1", "M2", "S2", "COV")])
    return out.withColumn("N", F.col("N").cast("long"))


def run_tests(run, tests: list[Test] | None = None) -> DataFrame:
    return S.compare(moments(run, tests), run.cfg.alpha, run.cfg.control)


#: Means whose tests are also run with Student's t.
STUDENT_TESTS = ("T03", "T04", "T08", "T09", "T12", "T18")


def run_student_tests(run) -> DataFrame:
    """Some tests of the combined family with Student's t for the means."""
    return S.compare(moments(run, [t for t in TESTS if t.id in STUDENT_TESTS]), run.cfg.alpha, run.cfg.control, student=True)


def output_table(run) -> DataFrame:
    """The published wide table, one row per variant."""
    return published(run, "output")


def published(run, name: str) -> DataFrame:
    """A published table (R01–R14) of the run."""
    if len(R.TABLES[name][0]) > 1:
        run.share_facts()
    return R.published_table(name, lambda family: family_aggregate(run, family))


def winsor_report(run) -> DataFrame:
    """Winsorization threshold, capped customers and their share, per location and variant."""
    frames = []
    run.share_facts()
    for loc, fam in (("ECOMM", "ecomm"), ("STORE", "store"), ("COMBINED", "combined")):
        a = family_aggregate(run, fam)
        frames.append(a.select(F.lit(loc).alias("LOCATION"), "VARIANT_ID", "WINSORIZATION_THRESHOLD", "WINSORIZED_CUSTOMERS",
                               "VISITORS", F.round(F.col("WINSORIZED_CUSTOMERS") / F.col("VISITORS") * 100, 6).alias("WINSORIZED_SHARE"),
                               F.when(F.round("WINSORIZATION_THRESHOLD", 2) == 0, "no capping (threshold 0)")
                               .otherwise("capped at 99th percentile").alias("NOTE")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
