"""Named queries over the driver's test tables (one per operator of the inventory).

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; nothing is
collected.  Builders run over the refresh window ``[1997-01-01, 1998-01-01)``,
the analysis over 1997-01-01 … 1997-12-31 with a decision-engine experiment
(household unit) and a click-stream experiment (web-visitor unit).
"""

from __future__ import annotations

import datetime
import uuid
import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expkit import config as C
from expkit.config import DEMO_CONFIG, DEMO_WEB_CONFIG, RefreshWindow
from expkit.operators import builders as B
from expkit.operators import daily as Y
from expkit.operators import exposure as X
from expkit.operators import metrics as M
from expkit.operators import power as P
from expkit.operators import reach as U
from expkit.operators import reconcile as V
from expkit.operators import scorecard as R
from expkit.plans import registry as G
from expkit.sources import sinks
from expkit.sources.adapters import Domain
from expkit.sources.session import ensure_checkpoint_dir
from expkit.sources.tables import Source, SourceTables

WINDOW = RefreshWindow(start=DEMO_CONFIG.start, end=DEMO_CONFIG.end_exclusive, selection="SAFE")
AS_OF = DEMO_CONFIG.end

Query = Callable[[SparkSession, str], DataFrame]


class Run:
    """Lazily built frames of one analysis run over one scale-factor folder, or over mapped source tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg=DEMO_CONFIG, w: RefreshWindow = WINDOW,
                 materialize: bool = True, custom_households: DataFrame | None = None, tables: SourceTables | None = None):
        self.d = tables if tables is not None else Domain(spark, sf_dir)
        self.cfg, self.w = cfg, w
        self.materialize = materialize
        self.custom_households = custom_households
        self._cache: dict[str, DataFrame] = {}
        self._shared = False

    def _get(self, key: str, fn) -> DataFrame:
        if key not in self._cache:
            self._cache[key] = fn()
        return self._cache[key]

    def share_facts(self) -> None:
        """For several families at once: the window's lines are joined to their orders once, its transactions built once."""
        if not self.materialize or self._shared:
            return
        self._shared = True
        if isinstance(self.d, Domain):
            self.d = self.d.keep_lines(self.w.start, self.w.end)

    # builders
    def combined_txns(self) -> DataFrame:
        return self._get("ct", lambda: (sinks.store if self._shared else lambda t: t)(B.combined_txns(self.d, self.w)))

    def combined_txns_md(self) -> DataFrame:
        return self._get("ctm", lambda: B.combined_txns(self.d, self.w, markdown=True))

    def redemptions(self) -> DataFrame:
        return self._get("red", lambda: B.redemptions(self.d, self.w))

    def visit_order(self) -> DataFrame:
        return self._get("vo", lambda: B.visit_order(self.d, self.w))

    def cart_coupon(self) -> DataFrame:
        return self._get("cc", lambda: B.cart_coupon(self.d, self.w))

    # per-location unit frames shared by the e-commerce, in-store and combined families
    def txn_shared(self) -> DataFrame:
        return self._get("txs", lambda: self._once(M.txn_location_units(self.exposure(), self.combined_txns(), self.cfg)))

    def red_shared(self) -> DataFrame:
        return self._get("rds", lambda: self._once(M.redemption_location_units(self.exposure(), self.combined_txns(),
                                                                               self.redemptions(), self.cfg)))

    def _once(self, units: DataFrame) -> DataFrame:
        """Unit frames read by several families are written once to the shared checkpoint folder."""
        return M.stored_units(units) if self.materialize else units

    # exposure
    def filter_households(self) -> DataFrame | None:
        """Households that the configured exposure filter (X10–X13) keeps; None without a filter."""
        kind, d = self.cfg.exposure_filter, self.d
        if kind == "SNAP":
            return X.filter_households_snap(d.txn_header, d.calendar, d.store, d.card_map, self.cfg)
        if kind == "BNC":
            return X.filter_households_bnc(d.txn_segments, self.cfg)
        if kind == "Page or OS platform":
            return X.filter_households_visits(d.visits, self.cfg, self.cfg.visit_zone)
        if kind == "Custom":
            if self.custom_households is None:
                raise ValueError("a custom exposure filter needs custom_households")
            return self.custom_households
        return None

    @classmethod
    def checked(cls, spark: SparkSession, sf_dir: str, cfg, today: datetime.date, w: RefreshWindow = WINDOW,
                stop_on_mismatch: bool = True, custom_households: DataFrame | None = None) -> "Run":
        """A run behind the published guards: the end date lies before ``today``, two controls are noticed,
        the metric tables cover the window, and the split passes the sample-ratio test."""
        cfg = cfg.clamp_end(today)
        run = cls(spark, sf_dir, cfg, w, custom_households=custom_households)
        controls = X.has_two_controls(X.experiment_lookup(run.d.campaign_recipes, cfg.experiment_id)).first()
        if controls is not None and controls["TWO_CONTROLS"]:
            run = cls(spark, sf_dir, replace(cfg, two_controls=True), w, custom_households=custom_households)
        V.assert_covered(V.coverage(run.combined_txns(), run.cfg))
        web = run.cfg.platform == "Adobe"
        lost = run.unmapped()
        if lost:
            warnings.warn(f"{lost} exposure rows have a code without a variant", stacklevel=2)
        counts = X.variant_counts(run.exposure(), web=web)
        verdict = X.srm_verdict(X.srm_pvalue(counts, "VISITOR_COUNT" if web else "HH_COUNT")).first()
        if stop_on_mismatch and (verdict is None or verdict["SRM"] != "OK"):
            raise RuntimeError(f"sample-ratio check: {verdict}")
        return run

    def unmapped(self) -> int:
        """Exposure rows of engine and list experiments whose code has no variant."""
        if self.cfg.platform == "Adobe":
            return 0
        if self.cfg.platform == "Decision Engine":
            events = X.engine_events(self.d.session_events, self.cfg, self.cfg.event_zone)
            lost = X.unmapped(events, "DECISION_ENGINE_VARIANT_CD", X.ENGINE_LETTERS)
        else:
            lost = X.unmapped(self.d.household_list, "VARIANT", C.VARIANT_LETTERS)
        return lost.first()["UNMAPPED_ROWS"]

    def raw_exposure(self) -> DataFrame:
        if self.cfg.platform == "Adobe":
            return self._get("xraw", lambda: X.exposure_web(self.d.hits, self.d.third_party_households, self.cfg))
        if self.cfg.platform == "Decision Engine":
            return self._get("xraw", lambda: X.exposure_engine(self.d.session_events, self.d.third_party_households, self.cfg,
                                                             self.cfg.event_zone))
        if self.cfg.platform in ("Push", "Email"):
            raise NotImplementedError(f"no exposure source is defined for platform {self.cfg.platform!r}")
        return self._get("xraw", lambda: X.exposure_list(self.d.household_list, self.d.third_party_households, self.cfg))

    def exposure(self) -> DataFrame:
        """Analysis exposure (one row per unit).  With ``materialize`` it is checkpointed to the shared
        checkpoint folder once per run, like the original's persisted exposure table: every metric
        family then starts from the written table instead of re-deriving exposures from raw events."""
        def build() -> DataFrame:
            e = X.analysis_exposure(self.raw_exposure(), self.cfg, self.filter_households())
            if self.materialize:
                e = M.stored_units(e)
            return e
        return self._get("x", build)


def engine_run(spark: SparkSession, sf_dir: str) -> "Run":
    return Run(spark, sf_dir, C.ExperimentConfig(**{**DEMO_CONFIG.__dict__, "platform": "Decision Engine"}))


def web_run(spark: SparkSession, sf_dir: str) -> "Run":
    return Run(spark, sf_dir, DEMO_WEB_CONFIG)


def list_run(spark: SparkSession, sf_dir: str) -> "Run":
    return Run(spark, sf_dir, DEMO_CONFIG)


WEB_FILTER_CONFIG = C.ExperimentConfig(**{**DEMO_WEB_CONFIG.__dict__, "page_filter": ("order confirmation", "home"),
                                           "os_platforms": ("iOS", "Web"), "excluded_banners": ("banner-south",)})
PAGE_FILTER_CONFIG = C.ExperimentConfig(**{**DEMO_CONFIG.__dict__, "page_filter": ("order confirmation",),
                                           "os_platforms": ("iOS",), "exposure_filter": "Page or OS platform"})


def _filtered_counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    base = PAGE_FILTER_CONFIG if kind == "Page or OS platform" else DEMO_CONFIG
    cfg = replace(base, exposure_filter=kind, platform="Decision Engine")
    # Page and OS restrict the households here, not the events.
    run = Run(spark, sf_dir, cfg)
    run._cache["xraw"] = engine_run(spark, sf_dir).raw_exposure()
    return X.variant_counts(run.exposure(), web=False)


def _mapped(spark: SparkSession, sf_dir: str) -> SourceTables:
    """The transaction and exposure tables under warehouse names, columns renamed, read through the contract."""
    d, sources = Domain(spark, sf_dir), {}
    for name in ("txn_facts", "txn_header", "calendar", "card_map", "session_events", "third_party_households"):
        table = d.table(name)
        renamed = {c: f"src_{c.lower()}" for c in table.columns}
        view = f"warehouse_{d.tag}_{name}"
        table.withColumnsRenamed(renamed).withColumn("loaded_at", F.lit("x")).createOrReplaceTempView(view)
        sources[name] = Source(view, renamed)
    return SourceTables(spark, sources)


def _mapped_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined family of a run that knows its tables by their mapping only."""
    run = Run(spark, sf_dir, engine_run(spark, sf_dir).cfg, tables=_mapped(spark, sf_dir))
    return M.aggregate(M.txn_units(run.exposure(), run.combined_txns(), run.cfg, None, shared=run.txn_shared()), M.txn_specs(run.cfg, "COMBINED"))


def _running_distinct(exposure: DataFrame, unit_col: str) -> DataFrame:
    exposure = M.stored_units(exposure)
    return U.running_distinct(U.daily_bitmaps(exposure, U.unit_numbers(exposure, unit_col), unit_col))


def _txn_days(run: Run) -> DataFrame:
    return Y.household_days(run.combined_txns(), run.cfg)


def _from_sums(run: Run, sums: DataFrame) -> DataFrame:
    """The combined family from looked-up totals instead of a join of the facts."""
    units = M.with_threshold(Y.since_exposure(run.exposure(), sums, run.cfg), {"_WIN_REV": "TOT_REVENUE"}, run.cfg)
    return M.aggregate(units, M.txn_specs(run.cfg, "COMBINED"))


def _two_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments over one stored table of suffix sums."""
    engine = engine_run(spark, sf_dir)
    sums = M.stored_units(Y.suffix_sums(_txn_days(engine)))
    both = [_from_sums(run, sums).select(F.lit(name).alias("EXPERIMENT"), "*") for name, run in (("engine", engine), ("list", list_run(spark, sf_dir)))]
    return both[0].unionByName(both[1])


def _combined_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the combined family as of every day, built in one go."""
    run = engine_run(spark, sf_dir)
    running = Y.running_units(Y.unit_days(run.exposure(), _txn_days(run), run.cfg))
    moves = Y.changes(Y.entries(run.exposure(), Y.TXN_MEASURES), running)
    return Y.txn_report(Y.as_of(Y.daily_states(moves, Y.TXN_METRICS)))


#: First day of the days that ``combined_daily_refreshed`` adds to a stored table.
REFRESH_FROM = "1997-07-01"


def _combined_daily_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored tables: built up to a day, then refreshed from that day on, twice."""
    run = engine_run(spark, sf_dir)
    cfg, root = run.cfg, f"{ensure_checkpoint_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex[:12]}"
    before = str(datetime.date.fromisoformat(REFRESH_FROM) - datetime.timedelta(days=1))
    # Each refresh reads the unit days again, so they are built from the facts once.
    active = sinks.store(Y.unit_days(run.exposure(), _txn_days(run), cfg))
    cut = F.lit(REFRESH_FROM).cast("date")
    early = Y.running_units(active.where(F.col("DAY") < cut))
    sinks.refresh_days(early, f"{root}/units", "DAY", cfg.start, before)
    entered = Y.entries(run.exposure(), Y.TXN_MEASURES)
    first = Y.daily_states(Y.changes(entered.where(F.col("DAY") < cut), sinks.read_days(spark, f"{root}/units", "DAY")), Y.TXN_METRICS)
    sinks.refresh_days(first, f"{root}/states", "DAY", cfg.start, before)
    for _ in range(2):  # a refresh that runs again replaces its own days
        known = sinks.read_days(spark, f"{root}/units", "DAY").where(F.col("DAY") < cut)
        sinks.refresh_days(Y.totals_before(known, active, REFRESH_FROM), f"{root}/units", "DAY", REFRESH_FROM, cfg.end)
        fresh = sinks.read_days(spark, f"{root}/units", "DAY").where(F.col("DAY") >= cut)
        added = Y.daily_states(Y.changes(Y.entries(run.exposure(), Y.TXN_MEASURES, REFRESH_FROM), fresh), Y.TXN_METRICS)
        sinks.refresh_days(added, f"{root}/states", "DAY", REFRESH_FROM, cfg.end)
    return Y.txn_report(Y.as_of(sinks.read_days(spark, f"{root}/states", "DAY")))


def _checked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant counts of a run that has passed its guards (the coverage of its own dates, the split noted, not stopped)."""
    d = Domain(spark, sf_dir)
    dates = B.combined_txns(d, WINDOW).agg(F.min("TXN_DTE").alias("a"), F.max("TXN_DTE").alias("b")).first()
    cfg = replace(engine_run(spark, sf_dir).cfg, start=str(dates["a"])[:10])
    run = Run.checked(spark, sf_dir, cfg, dates["b"] + datetime.timedelta(days=1), stop_on_mismatch=False)
    return X.variant_counts(run.exposure(), web=False)


def _listed_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom list of households: those of the first variant of the uploaded list."""
    return Domain(spark, sf_dir).household_list.where(F.col("VARIANT") == "A").select(F.col("HOUSEHOLD_ID").try_cast("bigint").alias("HOUSEHOLD_ID"))


def _power_results(d: Domain) -> DataFrame:
    """Power-analysis results by experiment, derived from its events (the test tables hold none)."""
    day = F.to_date("EVENT_TS")
    return d.session_events.groupBy(F.col("DECISION_ENGINE_EXPERIMENT_ID").alias("EXPERIMENT_ID")).agg(
        F.ceil(F.datediff(F.max(day), F.min(day)) / 7).alias("POWERED_ON_RPC_DURATION_IN_WEEKS"),
        F.count_distinct("HOUSEHOLD_ID").alias("POWERED_ON_RPC_HOUSEHOLDS"))


#: Targets in per cent: the default, and one that a small table reaches before the year is over.
POWER_TARGETS = (5.0, 40.0)


def _power_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten power fields from a year of visits and transactions, looked up as the scorecard does."""
    d, cfg = Domain(spark, sf_dir), DEMO_CONFIG
    days = P.household_days(B.txn_for_power(d, WINDOW), B.agp_daily(d, WINDOW), cfg)
    weekly = M.stored_units(P.weekly_moments(B.exposure_visit_for_power(d, WINDOW, cfg.event_zone), days, cfg))
    rows = [R.power_lookup(P.power_results(weekly, cfg.experiment_id, cfg.alpha, target=t), cfg.experiment_id).withColumn("TARGET_PCT", F.lit(t)) for t in POWER_TARGETS]
    return rows[0].unionByName(rows[1])


def _b(fn) -> Query:
    return lambda spark, sf: fn(Domain(spark, sf), WINDOW)


def _fam(units_fn, specs_fn, run_fn=engine_run) -> Query:
    def q(spark: SparkSession, sf: str) -> DataFrame:
        r = run_fn(spark, sf)
        return M.aggregate(units_fn(r), specs_fn(r.cfg))
    return q


QUERIES: dict[str, Query] = {
    # --- builders ---------------------------------------------------------
    "visit_order": _b(B.visit_order),
    "cart_coupon": _b(B.cart_coupon),
    "margin_weekly": _b(B.margin_weekly),
    "agp_daily": _b(B.agp_daily),
    "combined_txns": _b(B.combined_txns),
    "combined_txns_markdown": _b(lambda d, w: B.combined_txns(d, w, markdown=True)),
    "clips": _b(B.clips),
    "redemptions": _b(B.redemptions),
    "gas_txns": _b(B.gas_txns),
    "basket_time": _b(B.basket_time),
    "first_ecomm": _b(B.first_ecomm),
    "basket_health": _b(B.basket_health),
    "category_txns": _b(B.category_txns),
    "account_health": _b(B.account_health),
    "third_party_list": _b(B.third_party_list),
    "exposure_visit_power": _b(lambda d, w: B.exposure_visit_for_power(d, w, DEMO_CONFIG.event_zone)),
    "txn_power": _b(B.txn_for_power),
    "opt_in_push": lambda s, sf: B.opt_in(Domain(s, sf), "push_population", "push"),
    "opt_in_email": lambda s, sf: B.opt_in(Domain(s, sf), "email_population", "email"),
    "opt_in_sms": lambda s, sf: B.opt_in(Domain(s, sf), "sms_population", "sms"),
    "rewards_engaged": lambda s, sf: B.rewards_engaged(Domain(s, sf), AS_OF),
    "fact_segments": lambda s, sf: B.fact_segments(Domain(s, sf)),
    "myneeds": lambda s, sf: B.myneeds_segments(Domain(s, sf)),
    "primary_platform": lambda s, sf: B.primary_platform(B.exposure_visit_for_power(Domain(s, sf), WINDOW, DEMO_CONFIG.event_zone)),
    "division_mapping": lambda s, sf: B.division_mapping(Domain(s, sf)),
    # --- exposure -----------------------------------------------------------
    "experiment_lookup": lambda s, sf: X.experiment_lookup(Domain(s, sf).campaign_recipes, "EXP-20404"),
    "exposure_web": lambda s, sf: web_run(s, sf).raw_exposure(),
    "exposure_engine": lambda s, sf: engine_run(s, sf).raw_exposure(),
    "exposure_list": lambda s, sf: list_run(s, sf).raw_exposure(),
    "exposure_filter_snap": lambda s, sf: X.apply_exposure_filter(
        engine_run(s, sf).raw_exposure(),
        X.filter_households_snap(Domain(s, sf).txn_header, Domain(s, sf).calendar, Domain(s, sf).store,
                                 Domain(s, sf).card_map, DEMO_CONFIG)),
    "exposure_filter_bnc": lambda s, sf: X.apply_exposure_filter(
        engine_run(s, sf).raw_exposure(), X.filter_households_bnc(Domain(s, sf).txn_segments, DEMO_CONFIG)),
    "exposure_single_variant": lambda s, sf: X.single_variant(engine_run(s, sf).raw_exposure()),
    "exposure_dedup": lambda s, sf: engine_run(s, sf).exposure(),
    "exposure_split": lambda s, sf: web_run(s, sf).exposure(),
    "exposure_cumulative": lambda s, sf: X.cumulative_exposures(web_run(s, sf).raw_exposure(), "ADOBE_VISITOR_ID"),
    "exposure_running_distinct": lambda s, sf: _running_distinct(web_run(s, sf).raw_exposure(), "ADOBE_VISITOR_ID"),
    "exposure_running_households": lambda s, sf: _running_distinct(engine_run(s, sf).raw_exposure(), "HOUSEHOLD_ID"),
    "srm_raw": lambda s, sf: X.variant_counts(web_run(s, sf).raw_exposure(), web=True),
    "srm_dedup": lambda s, sf: X.variant_counts(X.single_variant(web_run(s, sf).raw_exposure()), web=True),
    "srm_final": lambda s, sf: X.variant_counts(web_run(s, sf).exposure(), web=True),
    "srm_test": lambda s, sf: X.srm_verdict(X.srm_pvalue(X.variant_counts(engine_run(s, sf).exposure(), web=False), "HH_COUNT")),
    "srm_daily": lambda s, sf: X.cumulative_srm(X.cumulative_exposures(web_run(s, sf).raw_exposure(), "ADOBE_VISITOR_ID")),
    "exposure_window": lambda s, sf: X.exposure_window(engine_run(s, sf).exposure()),
    # --- metric families ------------------------------------------------
    "engagement_variant": _fam(lambda r: M.engagement_units(r.exposure(), r.visit_order(), r.cart_coupon(), r.cfg),
                               M.engagement_specs, web_run),
    "engagement_variant_hh": _fam(lambda r: M.engagement_units(r.exposure(), r.visit_order(), r.cart_coupon(), r.cfg),
                                  M.engagement_specs),
    "margin_variant": _fam(lambda r: M.margin_units(r.exposure(), B.margin_weekly(r.d, r.w), r.cfg), M.margin_specs),
    "agp_variant": _fam(lambda r: M.agp_units(r.exposure(), B.agp_daily(r.d, r.w), r.cfg), M.agp_specs),
    "combined_variant": _fam(lambda r: M.txn_units(r.exposure(), r.combined_txns(), r.cfg, None, shared=r.txn_shared()),
                             lambda cfg: M.txn_specs(cfg, "COMBINED")),
    "ecomm_variant": lambda s, sf: (lambda r: M.location_variant(r.exposure(), r.combined_txns(), r.redemptions(), r.cfg,
                                                                 "ECOMM", B.first_ecomm(r.d, r.w), r.txn_shared(),
                                                                 r.red_shared()))(engine_run(s, sf)),
    "store_variant": lambda s, sf: (lambda r: M.location_variant(r.exposure(), r.combined_txns(), r.redemptions(), r.cfg,
                                                                 "STORE", None, r.txn_shared(),
                                                                 r.red_shared()))(engine_run(s, sf)),
    "redemptions_variant": _fam(lambda r: M.redemption_units(r.exposure(), r.combined_txns(), r.redemptions(), r.cfg, None,
                                                             shared=r.red_shared()),
                                lambda cfg: M.redemption_specs(cfg, None)),
    "bonus_points_variant": _fam(lambda r: M.bonus_units(r.exposure(), M.bonus_points_daily(r.d.points_header, r.d.points, r.cfg)),
                                 M.bonus_specs),
    "clips_variant": _fam(lambda r: M.clip_units(r.exposure(), B.clips(r.d, r.w), r.cfg), M.clip_specs),
    "basket_variant": _fam(lambda r: M.basket_units(r.exposure(), B.basket_health(r.d, r.w), r.cfg), M.basket_specs),
    "gas_variant": _fam(lambda r: M.gas_units(r.exposure(), B.gas_txns(r.d, r.w), r.cfg), M.gas_specs),
    "category_variant": _fam(lambda r: M.category_units(r.exposure(), B.category_txns(r.d, r.w), r.cfg), M.category_specs),
    "account_variant": _fam(lambda r: M.account_units(r.exposure(), B.account_health(r.d, r.w)), M.account_specs),
    "markdown_variant": _fam(lambda r: M.markdown_units(r.exposure(), r.combined_txns_md(), r.cfg), M.markdown_specs),
    "winsor_threshold": lambda s, sf: (lambda r: M.winsor_threshold(
        M.txn_units(r.exposure(), r.combined_txns(), r.cfg, None, shared=r.txn_shared()),
        {"WINSOR_THRESHOLD": "TOT_REVENUE"}, r.cfg))(engine_run(s, sf)),
    "winsor_threshold_exact": lambda s, sf: (lambda r: M.winsor_threshold(
        M.txn_units(r.exposure(), r.combined_txns(), r.cfg, None, shared=r.txn_shared()),
        {"WINSOR_THRESHOLD": "TOT_REVENUE"}, replace(r.cfg, exact_percentile=True)))(engine_run(s, sf)),
    "combined_from_mapped": _mapped_combined,
    # --- household days: look-ups instead of fact joins, moments day by day --------
    "combined_from_sums": lambda s, sf: (lambda r: _from_sums(r, M.stored_units(Y.suffix_sums(_txn_days(r)))))(engine_run(s, sf)),
    "combined_two_experiments": _two_experiments,
    "combined_daily": _combined_daily,
    "combined_daily_refreshed": _combined_daily_refreshed,
    # --- statistics and scorecard ----------------------------------------
    "tests_all": lambda s, sf: G.run_tests(engine_run(s, sf)),
    "tests_student": lambda s, sf: G.run_student_tests(engine_run(s, sf)),
    "scorecard_wide": lambda s, sf: R.results_wide(G.run_tests(engine_run(s, sf)), G.TESTS),
    "significance_signal": lambda s, sf: R.significance(G.run_tests(engine_run(s, sf)), G.TESTS, DEMO_CONFIG.alpha),
    "scorecard_formatted": lambda s, sf: R.formatted(G.run_tests(engine_run(s, sf)), G.TESTS),
    "key_metrics": lambda s, sf: R.key_metrics(G.run_tests(engine_run(s, sf)), G.TESTS, DEMO_CONFIG.alpha),
    "output_table": lambda s, sf: G.output_table(engine_run(s, sf)),
    "winsor_report": lambda s, sf: G.winsor_report(engine_run(s, sf)),
    # --- reconciliation ----------------------------------------------------
    "recon_baseline": lambda s, sf: V.baseline(Domain(s, sf).txn_facts, WINDOW),
    "recon_filtered": lambda s, sf: V.filtered(Domain(s, sf).txn_facts, Domain(s, sf).txn_header, WINDOW),
    "recon_excluded": lambda s, sf: V.excluded(Domain(s, sf).txn_facts, Domain(s, sf).txn_header, WINDOW),
    "recon_one_scan": lambda s, sf: V.one_scan(Domain(s, sf).txn_facts, Domain(s, sf).txn_header, WINDOW),
    "recon_identity": lambda s, sf: V.identity(B.combined_txns(Domain(s, sf), WINDOW, markdown=True)),
    "markdown_comparison": lambda s, sf: (lambda r: V.strategy_comparison(
        M.aggregate(M.markdown_units(r.exposure(), r.combined_txns_md(), r.cfg), M.markdown_specs(r.cfg)),
        M.aggregate(M.redemption_units(r.exposure(), r.combined_txns(), r.redemptions(), r.cfg, None,
                                       shared=r.red_shared()),
                    M.redemption_specs(r.cfg, None))))(engine_run(s, sf)),
    "coverage_check": lambda s, sf: V.coverage(B.combined_txns(Domain(s, sf), WINDOW), DEMO_CONFIG),
    "schema_check": lambda s, sf: V.row_count(B.combined_txns(Domain(s, sf), WINDOW, markdown=True)),
    # --- filtered exposures (page / OS / banner predicates) ------------------
    "exposure_web_filtered": lambda s, sf: X.exposure_web(Domain(s, sf).hits, Domain(s, sf).third_party_households,
                                                           WEB_FILTER_CONFIG),
    "exposure_filter_page": lambda s, sf: X.apply_exposure_filter(
        engine_run(s, sf).raw_exposure(), X.filter_households_visits(Domain(s, sf).visits, PAGE_FILTER_CONFIG, PAGE_FILTER_CONFIG.visit_zone)),
    # --- location markdown, display tables, run header ----------------------
    "markdown_ecomm": _fam(lambda r: M.markdown_units(r.exposure(), r.combined_txns_md(), r.cfg, "ECOMM"),
                           lambda cfg: M.markdown_specs(cfg, "ECOMM_")),
    "markdown_store": _fam(lambda r: M.markdown_units(r.exposure(), r.combined_txns_md(), r.cfg, "STORE"),
                           lambda cfg: M.markdown_specs(cfg, "STORE_")),
    # --- whole runs under an exposure filter: what is left to analyse ------------
    "run_snap": lambda s, sf: _filtered_counts(s, sf, "SNAP"),
    "run_bnc": lambda s, sf: _filtered_counts(s, sf, "BNC"),
    "run_page": lambda s, sf: _filtered_counts(s, sf, "Page or OS platform"),
    "run_custom": lambda s, sf: X.variant_counts(Run(s, sf, replace(engine_run(s, sf).cfg, exposure_filter="Custom"),
                                                     custom_households=_listed_households(s, sf)).exposure(), web=False),
    "run_checked": _checked_counts,
    "run_header": lambda s, sf: (lambda r: R.run_header(s, r.cfg, r.exposure()))(engine_run(s, sf)),
    "margin_refresh": lambda s, sf: B.margin_weekly(Domain(s, sf), WINDOW).agg(
        F.max("FISCAL_WEEK_END_DT").alias("MARGIN_REFRESH_DATE"), F.max("WEEK_ID").alias("LAST_WEEK_ID"),
        F.min("FISCAL_WEEK_START_DT").alias("FIRST_WEEK_START")),
    "two_controls": lambda s, sf: X.has_two_controls(X.experiment_lookup(Domain(s, sf).campaign_recipes, "EXP-20404")),
    "bonus_points_daily": lambda s, sf: (lambda r: M.bonus_points_daily(r.d.points_header, r.d.points, r.cfg))(engine_run(s, sf)),
    "missing_metrics": lambda s, sf: R.missing_metrics(G.run_tests(engine_run(s, sf))),
    "scorecard_published": lambda s, sf: R.published_scorecard(G.run_tests(engine_run(s, sf))),
    "scorecard_published_text": lambda s, sf: R.published_scorecard_text(G.run_tests(engine_run(s, sf))),
    "power_solved": _power_solved,
    "power_lookup": lambda s, sf: R.power_lookup(_power_results(Domain(s, sf)), DEMO_CONFIG.experiment_id),
}

for _name in R.TABLES:
    if _name != "output":
        QUERIES[f"table_{_name}"] = (lambda n: lambda s, sf: G.published(engine_run(s, sf), n))(_name)
