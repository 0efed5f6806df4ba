"""Exposure and assignment operators (X01–X20) and sample-ratio checks.

An exposure frame has one row per exposed unit with ``HOUSEHOLD_ID``,
``VARIANT_ID`` and ``EXPOSURE_DATETIME`` (a DATE), plus ``ID`` and
``ADOBE_VISITOR_ID`` for the click-stream platform.

"First row per key" selections use ``min(struct(order, tie-breakers, payload))``
aggregations instead of ``row_number`` windows: the aggregation is partial
(map-side), so a household or visitor holding a large share of the hits never
has to be sorted inside one task, and ties are broken deterministically (the
original leaves ties of a DATE ordering undefined).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit import config as C
from expkit.config import ExperimentConfig
from expkit.functions.columns import chi2_sf, keyed, like_any, num_key, page_patterns, try_int


def _d(s: str) -> Column:
    return F.lit(s).cast("date")


# ---------------------------------------------------------------------------
# X05 variant labels, X06/X08/X09 predicate builders, X07 third-party exclusion
# ---------------------------------------------------------------------------

def tnt_variant(tnt: Column, experiment_id: str, two_controls: bool = False) -> Column:
    """Variant from the experiment token ``<id>:<recipe>:0``, for any number of recipes (the smallest of several);
    with two controls recipes 0 and 1 are both A."""
    recipes = F.regexp_extract_all(tnt, F.lit(re.escape(experiment_id) + r":(\d{1,9}):0"), F.lit(1))
    recipe = F.array_min(F.transform(recipes, lambda r: r.cast("int")))
    index = F.greatest(recipe - 1, F.lit(0)) if two_controls else recipe
    # A to Z, then AA, AB, …
    letters = F.when(index < 26, F.char(index + 65)).otherwise(
        F.concat(F.char(F.floor(index / 26) + 64), F.char(index % 26 + 65)))
    return F.when(recipe.isNotNull(), F.concat(F.lit(C.variant_label("")), letters))


def code_variant(code: Column, letters: str) -> Column:
    out = None
    for ch in letters:
        out = F.when(code == ch, C.variant_label(ch)) if out is None else out.when(code == ch, C.variant_label(ch))
    return out


#: Codes that have a variant in engine experiments.
ENGINE_LETTERS = "ABCDEFG"


def unmapped(rows: DataFrame, code: str, letters: str) -> DataFrame:
    """One row: how many rows have a code without a variant (null included)."""
    return rows.agg(F.count_if(code_variant(F.col(code).cast("string"), letters).isNull()).alias("UNMAPPED_ROWS"))


def has_two_controls(recipes: DataFrame) -> DataFrame:
    """One-row frame: does any recipe name contain 'Control 2' (S14)."""
    return recipes.agg(F.max(F.col("RECIPE_NM").contains("Control 2").cast("int")).cast("boolean").alias("TWO_CONTROLS"))


def experiment_lookup(recipes: DataFrame, identifier: str, description_prefix: str = "EXP") -> DataFrame:
    """Distinct (campaign, recipe) by description when the identifier carries the ticket prefix
    (``<prefix>-<number>``), otherwise by a substring of the campaign id."""
    if identifier.split("-")[0] == description_prefix:
        f = F.col("CAMPAIGN_DSC").contains(identifier)
    else:
        f = F.col("CAMPAIGN_ID").cast("string").contains(identifier)
    return recipes.filter(f).select(F.col("CAMPAIGN_ID").cast("bigint").alias("CAMPAIGN_ID"), "RECIPE_NM").distinct()


def page_predicate(cfg: ExperimentConfig) -> Column | None:
    pats = page_patterns(cfg.page_filter)
    if not pats:
        return None
    if cfg.platform == "Adobe":
        return reduce(lambda a, b: a | b, [like_any(F.lower(c), pats)
                                            for c in ("POST_PAGENAME", "POST_EVAR151", "POST_EVAR152", "POST_EVAR153")])
    if cfg.platform == "Decision Engine":
        return F.lower("EVENT_TYPE_CD").like("%pageloaded%") & like_any(F.lower("EVENT_NM"), pats)
    if cfg.platform == "Household IDs":
        return like_any(F.col("PAGES_VIEWED_TXT"), pats)
    return None


def banner_predicate(cfg: ExperimentConfig) -> Column | None:
    banners = [b.strip().lower() for b in cfg.excluded_banners if b.strip() and b.strip().lower() != "none"]
    if not banners and not cfg.excluded_banners:
        return None
    banners = [b for b in banners if not b.startswith("business")]
    colname = {"Adobe": "POST_EVAR4", "Decision Engine": "BANNER_NM"}.get(cfg.platform)
    if colname is None:
        return None
    p = ~F.lower(colname).like("business%")
    if banners:
        p = p & ~F.lower(colname).isin(*banners)
    return p


def os_predicate(cfg: ExperimentConfig) -> Column | None:
    sel = set(cfg.os_platforms) - {"None"}
    if not sel:
        return None
    parts = []
    if cfg.platform == "Adobe":
        app = F.lower("POST_EVAR90").like("%app%")
        if "iOS" in sel:
            parts.append(app & F.lower("POST_EVAR116").like("%ios%"))
        if "Android" in sel:
            parts.append(app & F.lower("POST_EVAR116").like("%android%"))
        if "Web" in sel:
            parts.append(F.lower("POST_EVAR90").like("%web%"))
    elif cfg.platform == "Decision Engine":
        if "iOS" in sel:
            parts.append(F.lower("APP_VERSION_CD").like("%appios%"))
        if "Android" in sel:
            parts.append(F.lower("APP_VERSION_CD").like("%appand%"))
        if "Web" in sel:
            parts.append(F.lower("APP_VERSION_CD").like("%web%") | F.col("APP_VERSION_CD").isNull())
    elif cfg.platform == "Household IDs":
        os_ = F.lower("USER_OS_TYPE_CD")
        if "iOS" in sel:
            parts.append(os_.like("ios_app"))
        if "Android" in sel:
            parts.append(os_.like("android_app"))
        if "Web" in sel:
            parts.append(like_any(os_, ["%web", "desktop%"]))
    return reduce(lambda a, b: a | b, parts) if parts else None


def _apply(df: DataFrame, *preds: Column | None) -> DataFrame:
    for p in preds:
        if p is not None:
            df = df.filter(p)
    return df


def exclude_third_party(df: DataFrame, third_party: DataFrame, hh_col: str = "HOUSEHOLD_ID") -> DataFrame:
    """Drop listed households, keep rows without a household.

    NULL entries of the list are ignored (a literal ``NOT IN`` with a NULL would
    drop every known household).  Anti join on the non-null keys.
    """
    tp = third_party.select(try_int("HOUSEHOLD_ID").alias("_tp")).filter(F.col("_tp").isNotNull()).distinct()
    return df.join(tp, df[hh_col] == tp["_tp"], "left_anti")


# ---------------------------------------------------------------------------
# X01 web exposure, X02 decision-engine exposure, X03 household list
# ---------------------------------------------------------------------------

def exposure_web(hits: DataFrame, third_party: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """First hit per web visitor carrying the experiment token; household back-filled per device id."""
    d = F.to_date("DATE_TIME")
    h = hits.filter((F.to_date("DW_CREATETS") > F.date_sub(_d(cfg.start), 1))
                    & (d >= _d(cfg.start)) & (d <= _d(cfg.end))
                    & F.col("POST_TNT").like(f"%{cfg.experiment_id}%")
                    & (F.col("EXCLUDE_HIT").cast("int") == 0)
                    & ~F.col("HIT_SOURCE").cast("int").isin(*C.EXCLUDED_HIT_SOURCES))
    h = _apply(h, page_predicate(cfg), os_predicate(cfg), banner_predicate(cfg))
    h = h.select(F.concat("POST_VISID_HIGH", "POST_VISID_LOW").alias("ID"),
                 F.col("POST_EVAR49").alias("ADOBE_VISITOR_ID"),
                 try_int("POST_EVAR46").alias("CLUBCARD_ID"),
                 try_int("POST_EVAR47").alias("_hh"),
                 tnt_variant(F.col("POST_TNT"), cfg.experiment_id, cfg.two_controls).alias("VARIANT_ID"),
                 F.col("DATE_TIME"))
    # FIRST_VALUE(household IGNORE NULLS) over the whole device-id partition.
    hh = (h.filter(F.col("_hh").isNotNull()).groupBy("ID")
          .agg(F.min(F.struct("DATE_TIME", "_hh")).getField("_hh").alias("HOUSEHOLD_ID")))
    # First hit per visitor (ties broken by the remaining fields).
    first = (h.groupBy("ADOBE_VISITOR_ID")
             .agg(F.min(F.struct("DATE_TIME", "ID", "VARIANT_ID", "CLUBCARD_ID")).alias("_f"))
             .select("ADOBE_VISITOR_ID", "_f.ID", "_f.CLUBCARD_ID", "_f.VARIANT_ID",
                     F.to_date("_f.DATE_TIME").alias("EXPOSURE_DATETIME")))
    e = first.join(hh, "ID", "left").select("ID", "ADOBE_VISITOR_ID", "CLUBCARD_ID", "HOUSEHOLD_ID",
                                            "VARIANT_ID", "EXPOSURE_DATETIME")
    return exclude_third_party(e, third_party)


def engine_events(events: DataFrame, cfg: ExperimentConfig, zone: str) -> DataFrame:
    """Events of the experiment in its window and filters, whatever their variant code."""
    local_date = F.to_date(F.to_utc_timestamp("EVENT_TS", zone))
    ev = events.filter(F.col("DECISION_ENGINE_EXPERIMENT_ID").like(f"%{cfg.experiment_id}%") & local_date.between(_d(cfg.start), _d(cfg.end)))
    return _apply(ev, page_predicate(cfg), os_predicate(cfg), banner_predicate(cfg))


def exposure_engine(events: DataFrame, third_party: DataFrame, cfg: ExperimentConfig,
                    zone: str) -> DataFrame:
    """First event per experiment × household × variant; the exposure date is the zone-shifted event date."""
    ev = engine_events(events, cfg, zone).filter(F.col("DECISION_ENGINE_VARIANT_CD").cast("string").isin(*ENGINE_LETTERS))
    ev = exclude_third_party(ev, third_party)
    return (ev.groupBy("DECISION_ENGINE_EXPERIMENT_ID", "HOUSEHOLD_ID",
                       code_variant(F.col("DECISION_ENGINE_VARIANT_CD"), ENGINE_LETTERS).alias("VARIANT_ID"))
            .agg(F.min("EVENT_TS").alias("_ts"))
            .select(F.col("HOUSEHOLD_ID").cast("bigint").alias("HOUSEHOLD_ID"), "VARIANT_ID",
                    F.to_date(F.to_utc_timestamp("_ts", zone)).alias("EXPOSURE_DATETIME")))


FACTS_COLUMN_CANDIDATES = ("ANNUAL_FACTS", "TWELVE_WEEKS_FACTS", "FACTS")


def facts_column(df: DataFrame) -> str:
    """The segment column the assignment table carries (first of the known names)."""
    for c in FACTS_COLUMN_CANDIDATES[:-1]:
        if c in df.columns:
            return c
    return FACTS_COLUMN_CANDIDATES[-1]


def exposure_list(assignments: DataFrame, third_party: DataFrame, cfg: ExperimentConfig,
                  segmentation: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pre-assigned households; the exposure date is the experiment start."""
    fc = facts_column(assignments)
    e = assignments.select(try_int("HOUSEHOLD_ID").cast("bigint").alias("HOUSEHOLD_ID"),
                           code_variant(F.col("VARIANT"), C.VARIANT_LETTERS).alias("VARIANT_ID"),
                           F.col(fc), F.col("MYNEEDS"), *[F.col(s) for s in segmentation],
                           _d(cfg.start).alias("EXPOSURE_DATETIME")).distinct()
    return exclude_third_party(e, third_party)


# ---------------------------------------------------------------------------
# X10–X13 exposure filters
# ---------------------------------------------------------------------------

def filter_households_bnc(txn_segments: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    return (txn_segments.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end))
                                & F.col("SEGMENT_1").like(C.BNC_SEGMENT))
            .select(try_int("HHS_ID").alias("HOUSEHOLD_ID")))


def filter_households_snap(txn_header: DataFrame, calendar: DataFrame, store: DataFrame, card_map: DataFrame,
                           cfg: ExperimentConfig) -> DataFrame:
    """Households with SNAP/EBT tender in the window (register list and card key as the transaction builder)."""
    h = keyed(txn_header, "CARD_NBR").filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)) & (F.col("TXN_HDR_SRC_CD") == 0)
                          & F.col("REGISTER_NBR").isin(*C.SNAP_FILTER_REGISTERS)
                          & ((F.col("TENDER_AMT_FOODSTAMPS") + F.col("TENDER_AMT_EBT")) > 0))
    h = h.join(calendar.select(F.col("D_DATE").alias("TXN_DTE")), "TXN_DTE", "left_semi")
    st = store.select(num_key("RETAIL_STORE_FACILITY_NBR").alias("_sk"))
    h = h.join(st, num_key(h["STORE_ID"]) == st["_sk"], "left_semi")
    cards = card_map.select("HOUSEHOLD_ID", num_key("LOYALTY_PROGRAM_CARD_NBR").alias("_ck")).distinct()
    return h.join(cards, num_key(h["CARD_NBR"]) == cards["_ck"]).select("HOUSEHOLD_ID").distinct()


def filter_households_visits(visits: DataFrame, cfg: ExperimentConfig, zone: str) -> DataFrame:
    v = visits.filter(F.to_date(F.from_utc_timestamp("VISIT_START_TS", zone)).between(_d(cfg.start), _d(cfg.end)))
    hh_cfg = ExperimentConfig(**{**cfg.__dict__, "platform": "Household IDs"})
    v = _apply(v, page_predicate(hh_cfg), os_predicate(hh_cfg))
    return v.select(try_int("RETAIL_CUSTOMER_HHID_TXT").alias("HOUSEHOLD_ID")).distinct()


def apply_exposure_filter(exposure: DataFrame, households: DataFrame | None) -> DataFrame:
    """Keep exposures of listed households (semi join: a household listed twice is not duplicated)."""
    if households is None:
        return exposure
    hh = households.select(F.col("HOUSEHOLD_ID").alias("_fh")).filter(F.col("_fh").isNotNull())
    return exposure.join(hh, exposure["HOUSEHOLD_ID"] == hh["_fh"], "left_semi")


# ---------------------------------------------------------------------------
# X14 contamination, X15 unit split, X16 household dedupe
# ---------------------------------------------------------------------------

def single_variant(exposure: DataFrame) -> DataFrame:
    """Drop households seen in more than one variant; keep rows without a household."""
    ok = (exposure.filter(F.col("HOUSEHOLD_ID").isNotNull()).groupBy("HOUSEHOLD_ID")
          .agg(F.count_distinct("VARIANT_ID").alias("_nv")).filter(F.col("_nv") == 1)
          .select(F.col("HOUSEHOLD_ID").alias("_ok")))
    known = exposure.join(ok, exposure["HOUSEHOLD_ID"] == ok["_ok"], "left_semi")
    return known.unionByName(exposure.filter(F.col("HOUSEHOLD_ID").isNull()))


def _first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key by ``order`` (then the remaining columns) as a struct minimum.

    Grouped by a struct of the key so the aggregation never reuses a preceding join's partitioning on the
    same key: it gets its own exchange with map-side partial aggregation, and AQE may split that join.
    """
    others = [c for c in df.columns if c != key and c not in order]
    agg = df.groupBy(F.struct(key).alias("_k")).agg(F.min(F.struct(*order, *others)).alias("_f"))
    return agg.select(F.col(f"_k.{key}").alias(key), *[F.col(f"_f.{c}").alias(c) for c in order + others]).select(*df.columns)


WEB_COLUMNS = ["HOUSEHOLD_ID", "ID", "ADOBE_VISITOR_ID", "VARIANT_ID", "EXPOSURE_DATETIME"]


def split_units(exposure: DataFrame) -> DataFrame:
    """Web: first row per household, plus first row per visitor among rows without a household."""
    e = exposure.select(*WEB_COLUMNS)
    hh = _first_per(e.filter(F.col("HOUSEHOLD_ID").isNotNull()), "HOUSEHOLD_ID",
                    ["EXPOSURE_DATETIME", "VARIANT_ID", "ADOBE_VISITOR_ID", "ID"])
    vis = _first_per(e.filter(F.col("HOUSEHOLD_ID").isNull()), "ADOBE_VISITOR_ID",
                     ["EXPOSURE_DATETIME", "VARIANT_ID", "ID"])
    return hh.unionByName(vis)


def dedupe_households(exposure: DataFrame) -> DataFrame:
    """Non-web: first row per household (ties by variant, then the remaining columns)."""
    return _first_per(exposure, "HOUSEHOLD_ID", ["EXPOSURE_DATETIME", "VARIANT_ID"])


def analysis_exposure(raw: DataFrame, cfg: ExperimentConfig, households: DataFrame | None = None) -> DataFrame:
    """Raw exposure → filter → single-variant households → one row per unit."""
    e = single_variant(apply_exposure_filter(raw, households))
    return split_units(e) if cfg.platform == "Adobe" else dedupe_households(e)


# ---------------------------------------------------------------------------
# X17 cumulative exposures, X18–X20 counts, H03–H05 SRM
# ---------------------------------------------------------------------------

def srm_pvalue(counts: DataFrame, count_col: str, group_cols: list[str] | None = None,
               weights: dict[str, float] | None = None) -> DataFrame:
    """Chi-square goodness-of-fit p-value of the split in ``count_col`` across variants.

    ``counts`` has one row per (group…, VARIANT_ID).  Equal split unless
    ``weights`` (variant → share) is given.  Works on the small variant-level
    frame; nothing is collected.
    """
    g = group_cols or []
    c = counts
    if weights:
        w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        c = c.withColumn("_w", w[F.col("VARIANT_ID")])
    else:
        c = c.withColumn("_w", F.lit(1.0))
    tot = c.groupBy(*g).agg(F.sum(count_col).alias("_n"), F.sum("_w").alias("_wt"), F.count(F.lit(1)).alias("_k"))
    if g:
        j = c.join(tot, g, "inner")
    else:
        j = c
        for k in ("_n", "_wt", "_k"):
            j = j.withColumn(k, tot.select(k).scalar())
    exp = F.col("_n") * F.col("_w") / F.col("_wt")
    chi = j.groupBy(*g).agg(F.sum(F.pow(F.col(count_col) - exp, 2) / exp).alias("CHI2"),
                            F.max("_k").alias("_k"))
    return chi.select(*g, F.round("CHI2", 6).alias("CHI2"), (F.col("_k") - 1).alias("DF"),
                      F.round(chi2_sf(F.col("CHI2"), F.col("_k") - 1), 6).alias("P_VALUE"))


def srm_verdict(p: DataFrame, alpha: float = C.SRM_ALPHA) -> DataFrame:
    """MISMATCH, OK, or UNKNOWN where there is no p-value (a single variant, no rows)."""
    return p.withColumn("SRM", F.when(F.col("P_VALUE").isNull(), "UNKNOWN").when(F.round("P_VALUE", 4) < alpha, "MISMATCH").otherwise("OK"))


def cumulative_exposures(exposure: DataFrame, unit_col: str, control: str = C.CONTROL_VARIANT) -> DataFrame:
    """Distinct units per variant and date, running totals, and differences to the control."""
    from pyspark.sql.window import Window

    daily = (exposure.groupBy("VARIANT_ID", "EXPOSURE_DATETIME")
             .agg(F.count_distinct(unit_col).alias("distinct_visitors")))
    # The window runs over the variants × dates frame (tiny), not over exposure rows.
    w = Window.partitionBy("VARIANT_ID").orderBy("EXPOSURE_DATETIME").rangeBetween(Window.unboundedPreceding, 0)
    rolling = daily.withColumn("visitors_rolling", F.sum("distinct_visitors").over(w))
    ctrl = rolling.filter(F.col("VARIANT_ID") == control).select(
        "EXPOSURE_DATETIME", F.col("distinct_visitors").alias("distinct_visitors_control"),
        F.col("visitors_rolling").alias("visitors_rolling_control"))
    return (rolling.join(ctrl, "EXPOSURE_DATETIME", "left")
            .withColumn("distinct_visitors_diff", F.col("distinct_visitors") - F.col("distinct_visitors_control"))
            .withColumn("visitors_rolling_diff", F.col("visitors_rolling") - F.col("visitors_rolling_control")))


def cumulative_srm(cumulative: DataFrame) -> DataFrame:
    """SRM p-value of the running totals on every date."""
    p = srm_pvalue(cumulative.select("EXPOSURE_DATETIME", "VARIANT_ID", "visitors_rolling"),
                   "visitors_rolling", ["EXPOSURE_DATETIME"])
    return p.select("EXPOSURE_DATETIME", F.round("P_VALUE", 4).alias("SRM_P_VALUE"))


def variant_counts(exposure: DataFrame, web: bool) -> DataFrame:
    """Distinct households and visitors per variant (split by missing household for web).

    Each distinct count is an aggregation per variant and unit with flags, then per variant, so exposure
    rows are not expanded once per count; the results have a row per variant.
    """
    households = exposure.groupBy("VARIANT_ID").agg(F.count_distinct("HOUSEHOLD_ID").alias("HH_COUNT"))
    if not web:
        return households
    per_visitor = exposure.filter(F.col("ADOBE_VISITOR_ID").isNotNull()).groupBy("VARIANT_ID", "ADOBE_VISITOR_ID").agg(
        F.max(F.col("HOUSEHOLD_ID").isNull().cast("int")).alias("_without"), F.max(F.col("HOUSEHOLD_ID").isNotNull().cast("int")).alias("_with"))
    visitors = per_visitor.groupBy("VARIANT_ID").agg(
        F.count(F.lit(1)).alias("ADOBE_VISITORS"), F.sum("_without").alias("ADOBE_VISITORS_wNULL_HH"), F.sum("_with").alias("ADOBE_VISITORS_noNULL_HH"))
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ADOBE_VISITORS", "ADOBE_VISITORS_wNULL_HH", "ADOBE_VISITORS_noNULL_HH")]
    visitors = visitors.withColumnRenamed("VARIANT_ID", "_variant")
    out = households.join(visitors, households["VARIANT_ID"].eqNullSafe(visitors["_variant"]), "left").select("VARIANT_ID", "HH_COUNT", *none)
    return out.withColumn("VISITOR_COUNT", F.col("ADOBE_VISITORS_wNULL_HH") + F.col("HH_COUNT"))


def exposure_window(exposure: DataFrame) -> DataFrame:
    """First and last exposure date."""
    return exposure.agg(F.min("EXPOSURE_DATETIME").alias("FIRST_EXPOSED_DATE"),
                        F.max("EXPOSURE_DATETIME").alias("LAST_EXPOSED_DATE"))
