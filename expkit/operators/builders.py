"""Dataset builders of the metric refresh.

Each builder turns domain tables into one analysis-ready table for a refresh
window (``start`` inclusive, ``end`` exclusive unless noted).  ``src`` is any
object with ``table(name) -> DataFrame`` (``sources.adapters.Domain`` in
production, a dict-backed stub in unit tests).

Scale notes that apply throughout:
* facts are filtered and projected before any join, so Catalyst pushes the
  date predicates and column lists into the parquet scans;
* line-level facts are aggregated to transaction grain *before* the header
  join (map-side partial aggregation, then one shuffle on the transaction key);
* dimension tables (UPC, store, calendar, offers, partners, fiscal weeks) are
  left to the planner's size-checked broadcast (``autoBroadcastJoinThreshold``
  with AQE's runtime statistics) with sort-merge as the fallback — nothing here
  forces a broadcast of a table whose size grows with the facts;
* "latest record per key" and "mode per key" use ``max``/``min`` over structs
  (partial aggregation) instead of ``row_number`` windows, so a household with
  a third of all rows is reduced map-side rather than sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit import config as C
from expkit.config import RefreshWindow
from expkit.functions.columns import event_in_list, in_window, keyed, num_key, sunday_week_start, try_int


def _t(src, name: str) -> DataFrame:
    return src.table(name)


def _card_households(src) -> DataFrame:
    """Distinct (household, card) pairs with the normalised card key."""
    return (_t(src, "card_map").select("HOUSEHOLD_ID", "LOYALTY_PROGRAM_CARD_NBR").distinct()
            .withColumn("_card_key", num_key("LOYALTY_PROGRAM_CARD_NBR")))


def _lit_date(s: str) -> Column:
    return F.lit(s).cast("date")


# ---------------------------------------------------------------------------
# B01 visit_order
# ---------------------------------------------------------------------------

def visit_order(src, w: RefreshWindow) -> DataFrame:
    """Visits (kept if start or end date falls in the window) with their orders, revenue and units."""
    v = _t(src, "visits")
    start_d, end_d = F.to_date("VISIT_START_TS"), F.to_date("VISIT_END_TS")
    v = v.filter(((start_d >= _lit_date(w.start)) & (start_d < _lit_date(w.end)))
                 | ((end_d >= _lit_date(w.start)) & (end_d < _lit_date(w.end))))
    keys = ["VISIT_ID", "ID", "HOUSEHOLD_ID", "VISIT_START_TS", "VISIT_END_TS"]
    v = (v.select("VISIT_ID", F.col("VISITOR_ID").alias("ID"),
                  try_int("RETAIL_CUSTOMER_HHID_TXT").alias("HOUSEHOLD_ID"),
                  F.col("VISIT_START_TS").cast("timestamp").alias("VISIT_START_TS"),
                  F.col("VISIT_END_TS").cast("timestamp").alias("VISIT_END_TS"))
         .groupBy(*keys).agg(F.count(F.lit(1)).alias("_dup")))
    # Orders of the window's visits only (not the whole order history), pre-aggregated per visit: one row
    # per visit meets one row per visit.
    o = (_t(src, "order_journey").join(v.select("VISIT_ID").distinct(), "VISIT_ID", "left_semi").groupBy("VISIT_ID")
         .agg(F.count_distinct("ORDER_ID").alias("_orders"),
              F.sum(F.coalesce("GROSS_REVENUE_AMT", F.lit(0))).alias("_rev"),
              F.sum(F.coalesce("GROSS_UNIT_CNT", F.lit(0))).alias("_units")))
    j = v.join(o, "VISIT_ID", "left")
    return j.select(
        *keys,
        F.coalesce("_orders", F.lit(0)).cast("bigint").alias("NUM_ORDERS"),
        (F.coalesce("_rev", F.lit(0)) * F.col("_dup")).cast("decimal(38,4)").alias("TOT_REVENUE"),
        (F.coalesce("_units", F.lit(0)) * F.col("_dup")).cast("bigint").alias("NUM_UNITS"),
    )


# ---------------------------------------------------------------------------
# B02 cart_coupon
# ---------------------------------------------------------------------------

def cart_coupon(src, w: RefreshWindow) -> DataFrame:
    """Click hits classified as cart add / coupon clip / search (first matching code wins)."""
    h = _t(src, "hits")
    ca, cc, se = (event_in_list("POST_EVENT_LIST", c) for c in (C.EVENT_CART_ADD, C.EVENT_COUPON_CLIP, C.EVENT_SEARCH))
    d = F.to_date("DATE_TIME")
    h = h.filter((try_int("EXCLUDE_HIT") == 0)
                 & ~try_int("HIT_SOURCE").isin(*C.EXCLUDED_HIT_SOURCES)
                 & (ca | cc | se)
                 & (d >= _lit_date(w.start)) & (d < _lit_date(w.end)))
    return h.select(
        F.col("DATE_TIME").alias("DTE"),
        F.concat("POST_VISID_HIGH", "POST_VISID_LOW").alias("ID"),
        try_int("POST_EVAR47").alias("HOUSEHOLD_ID"),
        F.when(ca, "CART_ADD").when(cc, "COUPON_CLIP").when(se, "SEARCH").alias("EVENT_TYPE"),
    )


# ---------------------------------------------------------------------------
# B03 margin
# ---------------------------------------------------------------------------

def margin_weekly(src, w: RefreshWindow) -> DataFrame:
    """Weekly household margin in fiscal weeks starting from the Sunday week of start+3 up to end's week."""
    a = _t(src, "hh_weekly_margin")
    fw = _t(src, "fiscal_week")
    lo = sunday_week_start(F.date_add(_lit_date(w.start), 3))
    hi = sunday_week_start(_lit_date(w.end))
    fw = fw.filter((F.col("FISCAL_WEEK_START_DT") >= lo) & (F.col("FISCAL_WEEK_START_DT") < hi))
    return (a.join(fw, a["WEEK_ID"] == fw["FISCAL_WEEK_ID"], "inner")
            .select(try_int(a["HOUSEHOLD_ID"]).alias("HOUSEHOLD_ID"), a["WEEK_ID"],
                    "FISCAL_WEEK_START_DT", "FISCAL_WEEK_END_DT", "AGP_VAL_WITHOUT_INSTA_ADJ"))


# ---------------------------------------------------------------------------
# B04 agp
# ---------------------------------------------------------------------------

def _unit_rate(num: str) -> Column:
    q = F.col("ITEM_QTY")
    return F.when((q == 0) | q.isNull(), F.lit(0.0)).otherwise(F.col(num).cast("double") / q.cast("double"))


def agp_daily(src, w: RefreshWindow) -> DataFrame:
    """Household × day net sales, quantity, transactions, adjusted gross profit and markdowns."""
    upc = _t(src, "upc")
    store = _t(src, "store")
    agp = _t(src, "store_upc_agp").filter(in_window("TRANSACTION_DT", w.start, w.end))
    upc_ok = upc.filter(F.col("OWN_BRAND_UPC_IND") & (F.col("CORPORATION_ID") == "001")
                        & (F.col("SMIC_GROUP_ID") < C.AGP_MAX_GROUP_EXCLUSIVE)
                        & ~F.col("RETAIL_DEPARTMENT_ID").isin(*C.AGP_EXCLUDED_DEPARTMENTS))
    store_ok = store.filter(~F.col("DW_LOGICAL_DELETE_IND"))
    rates = (agp.join(upc_ok.select("UPC_NBR"), "UPC_NBR")
             .join(store_ok.select("FACILITY_INTEGRATION_ID", "RETAIL_STORE_FACILITY_NBR"), "FACILITY_INTEGRATION_ID")
             .select(num_key("RETAIL_STORE_FACILITY_NBR").alias("_store_key"),
                     F.col("UPC_NBR").alias("_upc"), F.col("TRANSACTION_DT").alias("_day"),
                     _unit_rate("AGP_EXTENDED_AMT").alias("_ext"),
                     _unit_rate("RETAIL_LATE_FLAT_ALLOWANCE_AMT").alias("_late"),
                     _unit_rate("RETAIL_NEW_ITEM_ALLOWANCE_AMT").alias("_new")))

    tf = (keyed(_t(src, "txn_facts"), "CARD_NBR")
          .filter(in_window("TXN_DTE", w.start, w.end) & F.col("REV_DTL_SUBTYPE_ID").isin(*C.REV_DTL_SUBTYPES)
                  & (F.col("DEPOSIT_ITEM_QTY") == 0))
          .select("TXN_ID", "TXN_DTE", "CARD_NBR", "STORE_ID", "UPC_ID", "NET_AMT", "MKDN_WOD_ALLOC_AMT",
                  "MKDN_POD_ALLOC_AMT", "ITEM_QTY", "MKDN_AMT"))
    u = upc_ok.select(num_key("UPC_NBR").alias("_upc_key"), F.col("RETAIL_DEPARTMENT_ID").alias("DEPARTMENT_ID"),
                      F.col("SMIC_CATEGORY_ID").alias("CATEGORY_ID"), F.col("SMIC_GROUP_ID").alias("GROUP_ID"))
    s = store_ok.select(num_key("RETAIL_STORE_FACILITY_NBR").alias("_store_key"))
    cards = _card_households(src).filter(num_key("HOUSEHOLD_ID") > 0)
    t1 = (tf.join(u, num_key(tf["UPC_ID"]) == u["_upc_key"])
          .join(s, num_key(tf["STORE_ID"]) == s["_store_key"])
          .join(cards, num_key(tf["CARD_NBR"]) == cards["_card_key"])
          .groupBy("HOUSEHOLD_ID", "UPC_ID", "STORE_ID", "TXN_DTE", "DEPARTMENT_ID", "CATEGORY_ID", "GROUP_ID", "TXN_ID")
          .agg(F.coalesce(F.sum(F.col("NET_AMT") + F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")), F.lit(0)).alias("NET_SALES"),
               F.coalesce(F.sum("ITEM_QTY"), F.lit(0)).alias("ITEM_QTY"),
               F.coalesce(F.sum("MKDN_AMT"), F.lit(0)).alias("MKDN_AMT"),
               F.coalesce(F.sum(F.col("MKDN_AMT") + F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")), F.lit(0)).alias("COMBINED_MKDN")))
    t2 = t1.join(rates, (t1["TXN_DTE"] == rates["_day"]) & (t1["UPC_ID"] == rates["_upc"])
                 & (num_key(t1["STORE_ID"]) == rates["_store_key"]), "left")
    agp_tot = (F.col("ITEM_QTY").cast("double") * (F.col("_ext") - F.col("_late") - F.col("_new"))).cast("double")
    return (t2.groupBy("HOUSEHOLD_ID", "TXN_DTE")
            .agg(F.sum("NET_SALES").cast("decimal(38,4)").alias("NET_SALES"),
                 F.sum("ITEM_QTY").cast("decimal(38,4)").alias("ITEM_QTY"),
                 F.count_distinct("TXN_ID").alias("TXNS"),
                 F.round(F.sum(agp_tot), 6).alias("AGP_TOT"),
                 F.sum("MKDN_AMT").cast("decimal(38,4)").alias("MKDN_AMT"),
                 F.sum("COMBINED_MKDN").cast("decimal(38,4)").alias("COMBINED_MKDN")))


# ---------------------------------------------------------------------------
# B05 / B05b / B16 combined transactions
# ---------------------------------------------------------------------------

def _txn_totals(src, w: RefreshWindow, markdown: bool) -> DataFrame:
    """Lines summed to transaction × date × card (filters: misc, deposit, revenue-detail subtype)."""
    tf = (keyed(_t(src, "txn_facts"), "CARD_NBR")
          .filter(in_window("TXN_DTE", w.start, w.end) & (F.col("MISC_ITEM_QTY") == 0)
                  & (F.col("DEPOSIT_ITEM_QTY") == 0) & F.col("REV_DTL_SUBTYPE_ID").isin(*C.REV_DTL_SUBTYPES)))
    aggs = [F.sum("GROSS_AMT").alias("REVENUE"),
            F.sum(F.col("NET_AMT") + F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")).alias("NET_SALES"),
            F.sum("ITEM_QTY").alias("ITEMS")]
    if markdown:
        aggs += [F.sum("MKDN_AMT").alias("MKDN_AMT"),
                 F.sum(F.col("MKDN_AMT") + F.col("MKDN_WOD_ALLOC_AMT") + F.col("MKDN_POD_ALLOC_AMT")).alias("COMBINED_MKDN")]
    return tf.groupBy("TXN_ID", "TXN_DTE", "CARD_NBR").agg(*aggs)


def txn_location(register: Column) -> Column:
    return (F.when(register.isin(*C.ECOMM_REGISTERS), "ECOMM")
            .when(register.isin(*C.STORE_REGISTERS), "STORE"))


def combined_txns(src, w: RefreshWindow, markdown: bool = False, register_filter: bool = True) -> DataFrame:
    """Transaction × household table with location and SNAP tender.

    ``markdown=True`` adds TOTAL_MARKDOWN (= revenue − net sales), MKDN_AMT and
    COMBINED_MKDN (B05b); ``register_filter=False`` gives the power-analysis
    variant without the register allow-list or location (B16).
    """
    tf = _txn_totals(src, w, markdown)
    hdr = _t(src, "txn_header").filter(F.col("TXN_HDR_SRC_CD") == 0)
    if register_filter:
        hdr = hdr.filter(F.col("REGISTER_NBR").isin(*(C.ECOMM_REGISTERS + C.STORE_REGISTERS)))
    hdr = hdr.select(F.col("TXN_ID").alias("_h_txn"), F.col("TXN_DTE").alias("_h_dte"), "REGISTER_NBR",
                     (F.col("TENDER_AMT_FOODSTAMPS") + F.col("TENDER_AMT_EBT")).alias("SNAP_TENDER"))
    cal = _t(src, "calendar").select(F.col("D_DATE").alias("_h_dte"))
    hdr = hdr.join(cal, "_h_dte", "left_semi")
    cards = _card_households(src)
    j = (tf.join(hdr, (tf["TXN_ID"] == hdr["_h_txn"]) & (tf["TXN_DTE"] == hdr["_h_dte"]))
         .join(cards, num_key(tf["CARD_NBR"]) == cards["_card_key"]))
    hh = cards["HOUSEHOLD_ID"] if register_filter else try_int(cards["HOUSEHOLD_ID"]).alias("HOUSEHOLD_ID")
    cols = [hh.alias("HOUSEHOLD_ID"), "TXN_DTE", "TXN_ID"]
    if register_filter:
        cols.append(txn_location(F.col("REGISTER_NBR")).alias("TXN_LOCATION"))
    cols += [F.col("REVENUE").cast("decimal(38,4)").alias("REVENUE"),
             F.col("NET_SALES").cast("decimal(38,4)").alias("NET_SALES"),
             F.col("ITEMS").cast("decimal(38,4)").alias("ITEMS"),
             F.col("SNAP_TENDER").cast("decimal(38,4)").alias("SNAP_TENDER")]
    if markdown:
        cols += [(F.col("REVENUE") - F.col("NET_SALES")).cast("decimal(38,4)").alias("TOTAL_MARKDOWN"),
                 F.col("MKDN_AMT").cast("decimal(38,4)").alias("MKDN_AMT"),
                 F.col("COMBINED_MKDN").cast("decimal(38,4)").alias("COMBINED_MKDN")]
    return j.select(*cols)


def txn_for_power(src, w: RefreshWindow) -> DataFrame:
    return combined_txns(src, w, markdown=False, register_filter=False)


# ---------------------------------------------------------------------------
# B06 clips / B07 redemptions
# ---------------------------------------------------------------------------

def _offer_attrs(src) -> DataFrame:
    return _t(src, "offer_bank").select("PROGRAM_TYPE", "PROGRAM_SUBTYPE", "PROGRAM_CODE", "OFFER_ID").distinct()


def offer_type_mod(pzn_subtypes: tuple[str, ...], fallback: str) -> Column:
    pt, code = F.col("PROGRAM_TYPE"), F.col("PROGRAM_CODE")
    return (F.when((pt == "PERSONALIZATION EXPERIMENT") & (code == "SPD"), "PZN")
            .when((pt == "CONTINUITY") & F.upper("PROGRAM_SUBTYPE").isin(*pzn_subtypes), "PZN")
            .when((pt != "PERSONALIZATION EXPERIMENT") & (pt != "CONTINUITY") & (code == "SPD"), "SPD")
            .otherwise(F.col(fallback)))


def clips(src, w: RefreshWindow) -> DataFrame:
    """Distinct household × offer × clip time with the re-classified offer type (end date inclusive)."""
    a = _t(src, "clips_raw").filter((F.col("CLIP_DT") >= _lit_date(w.start)) & (F.col("CLIP_DT") <= _lit_date(w.end)))
    j = a.join(_offer_attrs(src), a["CLIENT_OFFER_ID"] == F.col("OFFER_ID"), "left")
    return j.select(F.col("HOUSEHOLD_ID"), "CLIENT_OFFER_ID", "CLIP_TS",
                    offer_type_mod(C.CLIP_PZN_SUBTYPES, "OFFER_TYPE").alias("OFFER_TYPE_MOD")).distinct()


def redemptions(src, w: RefreshWindow) -> DataFrame:
    """Offer redemptions with re-classified type and markdown (fuel points at 0.01 per point)."""
    r = _t(src, "redemptions_raw").filter(in_window("TXN_DTE", w.start, w.end))
    j = r.join(_offer_attrs(src), r["CLIENT_OFFER_ID"] == F.col("OFFER_ID"), "left")
    mkdn = (F.when(F.col("FUEL_REWARD_POINTS") > 0, -F.col("FUEL_REWARD_POINTS") * F.lit(C.FUEL_POINTS_TO_DOLLARS))
            .otherwise(F.col("MKDN_AMT") + F.col("WOD_MKDN_AMT") + F.col("POD_MKDN_AMT")))
    return j.select("TXN_ID", "HOUSEHOLD_ID", "TXN_DTE", "CLIENT_OFFER_ID",
                    offer_type_mod(C.REDEMPTION_PZN_SUBTYPES, "OFFER_TYPE").alias("OFFER_TYPE_MOD"),
                    mkdn.cast("decimal(38,4)").alias("MKDN"))


# ---------------------------------------------------------------------------
# B08 gas transactions
# ---------------------------------------------------------------------------

def _fuel_rewards(src, w: RefreshWindow, own: bool) -> DataFrame:
    rt = _t(src, "reward_transactions")
    bp = _t(src, "business_partner")
    d = F.to_date("TRANSACTION_TS")
    rt = rt.filter((F.col("TRANSACTION_TYPE_CD") == "REDREQ") & (d >= _lit_date(w.start)) & (d < _lit_date(w.end))
                   & (F.col("DW_LAST_EFFECTIVE_DT") == _lit_date(C.SCD_OPEN_END))
                   & (F.col("REWARD_TOKEN_OFFERED_QTY") < 0)
                   & (try_int("PARTNER_DIVISION_ID") != C.FUEL_EXCLUDED_DIVISION))
    pid = try_int("PARTNER_ID")
    bp = bp.filter((F.col("DW_LAST_EFFECTIVE_DT") == _lit_date(C.SCD_OPEN_END))
                   & ((pid == C.OWN_FUEL_PARTNER) if own else (pid != C.OWN_FUEL_PARTNER)))
    return rt.join(bp.select("BUSINESS_PARTNER_INTEGRATION_ID", "PARTNER_ID"), "BUSINESS_PARTNER_INTEGRATION_ID")


def gas_txns(src, w: RefreshWindow) -> DataFrame:
    """Fuel transactions of households with own-station or partner fuel markdown."""
    hdr = (keyed(_t(src, "txn_header"), "CARD_NBR")
           .filter(in_window("TXN_DTE", w.start, w.end) & (F.col("TXN_HDR_SRC_CD") == 0)
                   & F.col("REGISTER_NBR").isin(*C.FUEL_REGISTERS)))
    cards = _card_households(src)
    g = (hdr.join(cards, num_key(hdr["CARD_NBR"]) == cards["_card_key"])
         .groupBy(try_int(cards["HOUSEHOLD_ID"]).alias("HOUSEHOLD_ID"), F.col("TXN_DTE"),
                  try_int(hdr["TXN_ID"]).alias("TXN_ID"))
         .agg(F.sum("TOTAL_GROSS_AMT").alias("REVENUE")))
    own = (_fuel_rewards(src, w, own=True).groupBy("HOUSEHOLD_ID")
           .agg(F.sum("REWARD_TOKEN_OFFERED_QTY").alias("o_redeemed"), F.sum("TOTAL_SAVINGS_VALUE_AMT").alias("o_mkdn")))
    special_id, special_mult = C.PARTNER_MULTIPLIER_SPECIAL
    mult = F.when(try_int("PARTNER_ID") == special_id, F.lit(special_mult)).otherwise(F.lit(C.PARTNER_MULTIPLIER_DEFAULT))
    base = (_fuel_rewards(src, w, own=False).groupBy("HOUSEHOLD_ID", "PARTNER_ID", mult.alias("multiplier"))
            .agg(F.sum("REWARD_TOKEN_OFFERED_QTY").alias("redeemed"), F.sum("TOTAL_PURCHASE_QTY").alias("gallons"),
                 F.sum("TOTAL_SAVINGS_VALUE_AMT").alias("mkdn")))
    partner = (base.groupBy("HOUSEHOLD_ID")
               .agg(F.sum("redeemed").alias("p_redeemed"), F.sum("mkdn").alias("p_mkdn"),
                    (F.sum("mkdn") - F.sum(F.col("gallons") * F.col("multiplier"))).alias("p_net")))
    own = own.withColumn("_hh", try_int("HOUSEHOLD_ID")).drop("HOUSEHOLD_ID")
    partner = partner.withColumn("_hh2", try_int("HOUSEHOLD_ID")).drop("HOUSEHOLD_ID")
    j = (g.join(own, g["HOUSEHOLD_ID"] == own["_hh"], "left")
         .join(partner, g["HOUSEHOLD_ID"] == partner["_hh2"], "left")
         .filter((F.col("o_mkdn") > 0) | (F.col("p_mkdn") > 0)))
    zero = F.lit(0)
    return j.select(
        "HOUSEHOLD_ID", "TXN_DTE", "TXN_ID", F.col("REVENUE").cast("decimal(38,4)").alias("REVENUE"),
        F.coalesce("o_mkdn", zero).cast("decimal(38,4)").alias("OWN_MKDN"),
        F.coalesce("p_mkdn", zero).cast("decimal(38,4)").alias("PARTNER_MKDN"),
        (F.coalesce("o_mkdn", zero) + F.coalesce("p_net", zero)).cast("decimal(38,4)").alias("GAS_MKDN"),
        (-(F.coalesce("o_redeemed", zero) + F.coalesce("p_redeemed", zero))).cast("decimal(38,4)").alias("GAS_REWARD_REDEMPTIONS"),
    )


# ---------------------------------------------------------------------------
# B09 basket build time
# ---------------------------------------------------------------------------

def basket_time(src, w: RefreshWindow) -> DataFrame:
    """App visits with at least two cart-add hits: minutes from first to last cart add."""
    h = _t(src, "hits")
    hh = F.lower(F.trim("POST_EVAR47"))
    h = h.filter((F.col("EXCLUDE_HIT") == "0") & (F.col("POST_EVAR90") != "web")
                 & ~F.col("HIT_SOURCE").isin("5", "7", "8", "9")
                 & ~hh.like("%id not found%") & ~hh.like("%-%")
                 & F.substring(F.trim("POST_EVAR47"), 1, 1).isin(*[str(i) for i in range(10)])
                 & (F.col("DATE_TIME") >= _lit_date(w.start).cast("timestamp"))
                 & (F.col("DATE_TIME") < _lit_date(w.end).cast("timestamp"))
                 & event_in_list("POST_EVENT_LIST", C.EVENT_CART_ADD))
    g = (h.groupBy(F.concat("POST_VISID_HIGH", "POST_VISID_LOW", "VISIT_NUM", "VISIT_START_TIME_GMT").alias("VISIT_ID"),
                   F.col("POST_EVAR49").alias("ADOBE_VISITOR_ID"), F.col("POST_EVAR47").alias("HOUSEHOLD_ID"))
         .agg(F.min("DATE_TIME").alias("VISIT_ST"), F.max("DATE_TIME").alias("VISIT_END"),
              F.count(F.lit(1)).alias("_hits"))
         .filter(F.col("_hits") >= 2).drop("_hits"))
    return g.withColumn("BASKET_BUILD_TIME", F.expr("timestampdiff(MINUTE, VISIT_ST, VISIT_END)"))


# ---------------------------------------------------------------------------
# B10 first e-commerce purchase, B11 basket health, B12 category transactions
# ---------------------------------------------------------------------------

def first_ecomm(src, w: RefreshWindow) -> DataFrame:
    """Households whose first pickup/delivery purchase falls in the window ('BNC TO ECOMM')."""
    prof = _t(src, "customer_profile").select("RETAIL_CUSTOMER_UUID", try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"))
    fe = (_t(src, "customer_first_event")
          .filter(~F.col("DW_LOGICAL_DELETE_IND") & F.col("DW_CURRENT_VERSION_IND")
                  & (F.col("FIRST_DELIVERY_DT").isNotNull() | F.col("FIRST_DUG_DT").isNotNull()))
          # Spark's least() skips NULLs, which is exactly the CASE of the original.
          .select("RETAIL_CUSTOMER_UUID", F.least("FIRST_DELIVERY_DT", "FIRST_DUG_DT").alias("FIRST_ECOMM_DT"))
          .filter(in_window("FIRST_ECOMM_DT", w.start, w.end)))
    return (fe.join(prof, "RETAIL_CUSTOMER_UUID")
            .groupBy("HOUSEHOLD_ID", F.lit(C.BNC_SEGMENT).alias("BNC_SEGMENT"))
            .agg(F.min("FIRST_ECOMM_DT").alias("TXN_DTE")))


def basket_health(src, w: RefreshWindow) -> DataFrame:
    bh = _t(src, "basket_grades")
    cs = _t(src, "txn_segments").filter(F.col("SEGMENT_1").isNotNull() & in_window("TXN_DTE", w.start, w.end))
    return (cs.join(bh, "TXN_ID")
            .select(try_int("HHS_ID").alias("HOUSEHOLD_ID"), "TXN_DTE", "OVERALL_CATEGORY", "TXN_ID")
            .distinct())


def category_txns(src, w: RefreshWindow) -> DataFrame:
    """Transaction × household × category revenue and quantity over the filtered product hierarchy."""
    t = (keyed(_t(src, "txn_facts"), "CARD_NBR")
         .filter(in_window("TXN_DTE", w.start, w.end) & (F.col("TXN_HDR_SRC_CD") == 0) & (F.col("MISC_ITEM_QTY") == 0)
                 & (F.col("DEPOSIT_ITEM_QTY") == 0) & F.col("REV_DTL_SUBTYPE_ID").isin(*C.REV_DTL_SUBTYPES))
         .select("TXN_ID", "TXN_DTE", "CARD_NBR", "STORE_ID", "UPC_ID", "GROSS_AMT", "ITEM_QTY"))
    h = (_t(src, "upc")
         .filter(F.col("OWN_BRAND_UPC_IND") & (F.col("CORPORATION_ID") == "001")
                 & ~F.col("RETAIL_DEPARTMENT_ID").isin(*C.CATEGORY_EXCLUDED_DEPARTMENTS)
                 & ~F.col("SMIC_GROUP_ID").cast("string").isin(*C.CATEGORY_EXCLUDED_GROUPS)
                 & ~F.col("DW_LOGICAL_DELETE_IND") & (F.col("RETAIL_DEPARTMENT_ID") != "N/A"))
         .select(num_key("UPC_NBR").alias("_upc_key"), "SMIC_CATEGORY_ID", "SMIC_CATEGORY_DSC", "DEPARTMENT_NM"))
    s = (_t(src, "store").filter(~F.col("DW_LOGICAL_DELETE_IND") & ~F.col("PARENT_OPERATING_AREA_CD").isin("N/A"))
         .select(num_key("RETAIL_STORE_FACILITY_NBR").alias("_store_key")))
    cards = _card_households(src).filter(num_key("HOUSEHOLD_ID") > 0)
    j = (t.join(h, num_key(t["UPC_ID"]) == h["_upc_key"])
         .join(s, num_key(t["STORE_ID"]) == s["_store_key"])
         .join(cards, num_key(t["CARD_NBR"]) == cards["_card_key"]))
    return (j.groupBy("TXN_ID", "HOUSEHOLD_ID", "TXN_DTE", "SMIC_CATEGORY_ID", "SMIC_CATEGORY_DSC", "DEPARTMENT_NM")
            .agg(F.coalesce(F.sum("GROSS_AMT"), F.lit(0)).cast("decimal(38,4)").alias("REVENUE"),
                 F.coalesce(F.sum("ITEM_QTY"), F.lit(0)).cast("decimal(38,4)").alias("ITEM_QTY")))


# ---------------------------------------------------------------------------
# B13 account health
# ---------------------------------------------------------------------------

def account_health(src, w: RefreshWindow | None = None) -> DataFrame:
    """Per household 0/1 presence of e-mail, phone, name, birthday, address and employee flags.

    One shuffle: every flag source contributes (household key, flag name); a
    single aggregation pivots them, instead of seven left joins with distinct
    counts.  The name flag is a plain 0/1 (the original's ``CAST(n/2 AS INT)``
    rounds 0.5 up to the same 1).
    """
    prof = _t(src, "customer_profile")
    card = _t(src, "card_map")
    cur = F.col("DW_CURRENT_VERSION_IND")

    def flag(df: DataFrame, hh: str, name: str) -> DataFrame:
        return df.select(num_key(hh).alias("_k"), F.lit(name).alias("_flag"))

    email = (_t(src, "digital_contact").alias("a").join(prof.alias("b"), "RETAIL_CUSTOMER_UUID")
             .filter(F.col("a.DW_CURRENT_VERSION_IND") & F.col("a.EMAIL_ID").isNotNull()
                     & ~F.col("a.EMAIL_ID").like(C.EMAIL_PLACEHOLDERS[0])))
    phone = (_t(src, "phone_contact").alias("a").join(prof.alias("b"), "RETAIL_CUSTOMER_UUID")
             .filter(F.col("b.DW_CURRENT_VERSION_IND") & F.col("b.PHONE_NBR").isNotNull()
                     & ~F.col("b.PHONE_NBR").like(C.PHONE_PLACEHOLDERS[0])))
    names = prof.filter(F.col("FIRST_NM").isNotNull() & ~F.col("FIRST_NM").isin(*C.FIRST_NAME_PLACEHOLDERS)
                        & F.col("LAST_NM").isNotNull() & ~F.col("LAST_NM").isin(*C.LAST_NAME_PLACEHOLDERS) & cur)
    bday = card.filter(F.col("BIRTH_DT").isNotNull() & ~F.col("BIRTH_DT").like(C.BIRTH_DATE_PLACEHOLDERS[0]))
    addr = prof.filter(F.col("ZIPCODE").isNotNull() & (F.col("ZIPCODE") != "N/A") & cur)
    flags = (flag(email, "b.HOUSEHOLD_ID", "email_ind")
             .unionByName(flag(phone, "b.HOUSEHOLD_ID", "phone_ind"))
             .unionByName(flag(names, "HOUSEHOLD_ID", "fn_ln_ind"))
             .unionByName(flag(bday, "HOUSEHOLD_ID", "bday_ind"))
             .unionByName(flag(addr, "HOUSEHOLD_ID", "address_ind"))
             .unionByName(flag(card.filter(F.col("EMPLOYEE_IND")), "HOUSEHOLD_ID", "smv_emp_ind"))
             .unionByName(flag(prof.filter(F.col("EMPLOYEE_IND")), "HOUSEHOLD_ID", "c360_emp_ind"))
             .filter(F.col("_k").isNotNull()))
    names_all = ["email_ind", "phone_ind", "fn_ln_ind", "bday_ind", "address_ind", "smv_emp_ind", "c360_emp_ind"]
    per_hh = flags.groupBy("_k").agg(*[F.max((F.col("_flag") == n).cast("int")).alias(n) for n in names_all])
    base = prof.select(F.col("HOUSEHOLD_ID").alias("household_id")).distinct()
    x = base.join(per_hh, num_key("household_id") == per_hh["_k"], "left").select(
        "household_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names_all])
    div_names = _t(src, "store").select(num_key("DIVISION_ID").alias("_dk"), F.col("DIVISION_NM").alias("prim_division_nm")).distinct()
    div = (prof.filter(F.col("PRIM_DIVISION_ID").isNotNull())
           .select(F.col("HOUSEHOLD_ID").alias("_dh"), F.col("PRIM_DIVISION_ID").alias("prim_division_id")))
    div = (div.join(div_names, num_key("prim_division_id") == div_names["_dk"], "left")
           .select("_dh", "prim_division_id", "prim_division_nm").distinct())
    return (x.join(div, num_key(x["household_id"]) == num_key(div["_dh"]), "left")
            .select(*x.columns, "prim_division_id", "prim_division_nm"))


# ---------------------------------------------------------------------------
# B14 third-party households, B15 visits for power, B17–B19 opt-ins, B20 rewards engaged
# ---------------------------------------------------------------------------

def third_party_list(src, w: RefreshWindow | None = None) -> DataFrame:
    return _t(src, "third_party_households").select("HOUSEHOLD_ID")


def exposure_visit_for_power(src, w: RefreshWindow, zone: str) -> DataFrame:
    """Projected visits whose start date lies strictly between the zone-shifted window ends."""
    v = _t(src, "visits")
    d = F.to_date("VISIT_START_TS").cast("timestamp")
    lo = F.from_utc_timestamp(_lit_date(w.start).cast("timestamp"), zone)
    hi = F.from_utc_timestamp(_lit_date(w.end).cast("timestamp"), zone)
    return v.filter((d > lo) & (d < hi)).select(
        F.col("VISIT_START_TS").cast("timestamp").alias("VISIT_START_TS"), "VISITOR_ID",
        try_int("RETAIL_CUSTOMER_HHID_TXT").alias("RETAIL_CUSTOMER_HHID_TXT"),
        "ADOBE_VISITOR_ID_TXT", "SIGN_IN_IND", F.col("BANNER_NM_TXT").alias("BANNER_NM"),
        F.lower("USER_OS_TYPE_CD").alias("USER_OS_TYPE_CD"), "PAGES_VIEWED_TXT")


def opt_in(src, population: str, label: str) -> DataFrame:
    return (_t(src, population)
            .select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"), F.lit(label).alias("DIGITAL_REACH"))
            .distinct())


def rewards_engaged(src, as_of: str) -> DataFrame:
    """Households with grocery or gas redemptions in fiscal weeks starting within 84 days of ``as_of``."""
    c = _t(src, "hh_engagement_weekly").filter((F.col("GR_REDEMPTIONS") > 0) | (F.col("GAS_REDEMPTIONS") > 0))
    fw = _t(src, "fiscal_week").filter(F.col("FISCAL_WEEK_START_DT").between(
        F.date_sub(_lit_date(as_of), C.REWARDS_LOOKBACK_DAYS), _lit_date(as_of)))
    return (c.join(fw.select(F.col("FISCAL_WEEK_ID")), "FISCAL_WEEK_ID")
            .select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"), F.lit(1).alias("rewards_engaged"))
            .distinct())


# ---------------------------------------------------------------------------
# B21 FACTS segments, B22 MyNeeds, B23 primary platform, B24 division mapping
# ---------------------------------------------------------------------------

def _label(c: Column, mapping: dict, default: str | None = None) -> Column:
    out = None
    for keys, lab in mapping.items():
        keys = keys if isinstance(keys, tuple) else (keys,)
        cond = c.isin(*keys)
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.otherwise(F.lit(default)) if default is not None else out


def fact_segments(src) -> DataFrame:
    """Latest-week segment and the 12-week modal segment (ties → smallest id) per household."""
    fs = _t(src, "facts_segment_week")
    latest = (fs.groupBy("HOUSEHOLD_ID")
              .agg(F.max(F.struct("WEEK_ID", "FACTS_LEVEL2_SEGMENT_ID")).alias("_m"))
              .select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"),
                      _label(F.col("_m.FACTS_LEVEL2_SEGMENT_ID"), C.FACTS_LATEST_LABELS, "unknown").alias("FACTS")))
    max_week = fs.agg(F.max("WEEK_ID")).scalar()
    recent = (fs.filter((F.col("WEEK_ID") >= max_week - (C.SEGMENT_LOOKBACK_WEEKS - 1))
                      & F.col("FACTS_LEVEL2_SEGMENT_ID").isNotNull())
              .select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"), "FACTS_LEVEL2_SEGMENT_ID"))
    counts = recent.groupBy("HOUSEHOLD_ID", "FACTS_LEVEL2_SEGMENT_ID").agg(F.count(F.lit(1)).alias("_n"))
    mode = (counts.groupBy("HOUSEHOLD_ID")
            .agg(F.min(F.struct((-F.col("_n")).alias("_negn"), F.col("FACTS_LEVEL2_SEGMENT_ID").alias("_seg"))).alias("_b"))
            .select("HOUSEHOLD_ID",
                    _label(F.col("_b._seg"), C.FACTS_MODE_LABELS, "unknown").alias("TWELVE_WEEKS_FACTS"),
                    _label(F.col("_b._seg"), C.FACTS_MODE_DETAIL_LABELS, "unknown").alias("TWELVE_WEEKS_FACTS_DETAIL")))
    j = latest.alias("L").join(mode.alias("W"), F.col("L.HOUSEHOLD_ID") == F.col("W.HOUSEHOLD_ID"), "full")
    return j.select(F.coalesce("L.HOUSEHOLD_ID", "W.HOUSEHOLD_ID").alias("HOUSEHOLD_ID"),
                    F.coalesce("L.FACTS", F.lit("unknown")).alias("FACTS"),
                    F.coalesce("W.TWELVE_WEEKS_FACTS", F.lit("unknown")).alias("TWELVE_WEEKS_FACTS"),
                    F.coalesce("W.TWELVE_WEEKS_FACTS_DETAIL", F.lit("unknown")).alias("TWELVE_WEEKS_FACTS_DETAIL"))


def myneeds_segments(src) -> DataFrame:
    a = _t(src, "attitudinal_segments")
    latest = a.groupBy("HOUSEHOLD_ID").agg(F.max(F.struct("START_WEEK_ID", "SEGMENT")).alias("_m"))
    return latest.select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"),
                         _label(F.col("_m.SEGMENT"), C.MYNEEDS_LABELS).alias("MYNEEDS"))


def primary_platform(visits_for_power: DataFrame) -> DataFrame:
    """App vs web visit counts per household and the dominant platform (conditional sums, no self-join)."""
    v = visits_for_power.filter(F.col("RETAIL_CUSTOMER_HHID_TXT").isNotNull())
    is_app = F.lower("USER_OS_TYPE_CD").like("%app%")
    g = (v.groupBy(F.col("RETAIL_CUSTOMER_HHID_TXT").alias("HOUSEHOLD_ID"))
         .agg(F.sum(F.when(~is_app | is_app.isNull(), 1).otherwise(0)).cast("bigint").alias("WEB_TRAFFIC"),
              F.sum(F.when(is_app, 1).otherwise(0)).cast("bigint").alias("UMA_TRAFFIC")))
    tot = F.col("WEB_TRAFFIC") + F.col("UMA_TRAFFIC")
    pct_web = F.col("WEB_TRAFFIC") / tot
    return g.select("HOUSEHOLD_ID", "WEB_TRAFFIC", "UMA_TRAFFIC", tot.alias("TOTAL_DIGITAL_TRAFFIC"),
                    pct_web.alias("PCT_WEB"), (F.col("UMA_TRAFFIC") / tot).alias("PCT_UMA"),
                    F.when(pct_web < C.PLATFORM_UMA_BELOW, "UMA").when(pct_web > C.PLATFORM_WEB_ABOVE, "WEB")
                    .otherwise("BOTH").alias("PRIMARY_PLATFORM"))


def division_mapping(src) -> DataFrame:
    """Latest primary store per household with its division and banner."""
    m = (_t(src, "store").filter(~F.col("DIVISION_NM").isin("N/A", "TEST") & ~F.col("DW_LOGICAL_DELETE_IND"))
         .select(try_int("DIVISION_ID").alias("DIVISION_ID"), "DIVISION_NM", "BANNER_NM",
                 try_int("RETAIL_STORE_FACILITY_NBR").alias("STORE_ID")).distinct())
    a = (_t(src, "hh_primary_store")
         .select(try_int("HOUSEHOLD_ID").alias("HOUSEHOLD_ID"),
                 try_int("PGM_PERIOD_ID").alias("PGM_PERIOD_ID"),
                 try_int("PRIM_STORE_ID").alias("PRIM_STORE_ID")))
    latest = (a.groupBy("HOUSEHOLD_ID").agg(F.max(F.struct("PGM_PERIOD_ID", "PRIM_STORE_ID")).alias("_m"))
              .select("HOUSEHOLD_ID", "_m.PGM_PERIOD_ID", "_m.PRIM_STORE_ID"))
    j = latest.join(m, latest["PRIM_STORE_ID"] == m["STORE_ID"], "left")
    return j.select("HOUSEHOLD_ID", "PGM_PERIOD_ID", "PRIM_STORE_ID", "DIVISION_ID", "DIVISION_NM", "BANNER_NM")
