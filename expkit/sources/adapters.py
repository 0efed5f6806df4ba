"""Test-data adapters: driver tables → the retail domain the operators read.

The driver ships TPC-H-like tables (customer, orders, lineitem, part, supplier,
nation, region) plus a click ``events`` table.  Each domain table below is a
SELECT over those tables (or over another domain table), written once in the
SQL subset Spark and DuckDB share; a small ``Dialect`` object fills the few
spots where the two differ.  Spark runs the text through ``spark.sql`` (so
Catalyst prunes columns and pushes filters into the parquet scans); the
DuckDB oracle inlines the same text as CTEs.  Identical inputs on both sides
make the operator comparison meaningful.

Mapping (a customer is a household; an order is a transaction; a line item
is a transaction line; a part is a UPC and an offer; a supplier is a store):

* events are shifted by 9802 days so the click month (2024-01) lands in
  1997-03, inside the order history (1995-01 … 2001-08);
* every 13th user has no household id; every 11th user browses on two
  devices that land in different variants;
* every 17th household is assigned to two variants; every 29th household is a
  third-party household;
* an order's priority decides its register: 1-URGENT → 99 (e-commerce),
  2-HIGH → 104 (e-commerce), 3-MEDIUM → 1 or 120 (store), 4-NOT SPECIFIED → 23
  (outside the allow-list), 5-LOW → 44 (fuel).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expkit.sources import sinks

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

EVENT_SHIFT_DAYS = 9802  # 2024-01-01 → 1997-03-01
WEB_EXPERIMENT_ID = "777"
ENGINE_EXPERIMENT_ID = "DE-42"


class Dialect:
    """Spots where Spark SQL and DuckDB SQL differ."""

    name = "spark"

    def __init__(self, table_ref: Callable[[str], str], adapter_ref: Callable[[str], str]):
        self.t = table_ref
        self.a = adapter_ref

    def lines(self) -> str:
        """Lines (``l``) with their orders (``o``)."""
        return f"{self.t('lineitem')} l JOIN {self.t('orders')} o ON l.l_orderkey = o.o_orderkey"

    def days(self, e: str) -> str:
        return f"unix_date({e})"

    def date_series(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))"


class KeptLinesDialect(Dialect):
    """Lines and orders that ``Domain.keep_lines`` has joined and written."""

    def __init__(self, table_ref: Callable[[str], str], adapter_ref: Callable[[str], str], kept: str):
        super().__init__(table_ref, adapter_ref)
        self.kept = kept

    def lines(self) -> str:
        return self.kept


class DuckDialect(Dialect):
    name = "duckdb"

    def days(self, e: str) -> str:
        return f"(({e}) - DATE '1970-01-01')"

    def date_series(self, lo: str, hi: str) -> str:
        return f"unnest(generate_series({lo}, {hi}, INTERVAL 1 DAY))::DATE"


def _week_id(d: Dialect, e: str) -> str:
    """Sunday-based week number (1970-01-04 starts week 1)."""
    return f"CAST(FLOOR(({d.days(e)} + 4) / 7) AS INT)"


def _week_start(d: Dialect, e: str) -> str:
    return f"({e} - CAST(({d.days(e)} + 4) % 7 AS INT))"


def _card(e: str) -> str:
    """Loyalty card number of a customer key; every 97th transaction carries an unreadable card."""
    return f"lpad(CAST({e} AS STRING), 12, '0')"


def _offer_type(e: str) -> str:
    return (f"CASE {e} % 6 WHEN 0 THEN 'PD' WHEN 1 THEN 'GR' WHEN 2 THEN 'MF' "
            f"WHEN 3 THEN 'SC' WHEN 4 THEN 'SPD' ELSE 'PZN' END")


def _banner(e: str) -> str:
    return (f"CASE {e} % 5 WHEN 0 THEN 'banner-north' WHEN 1 THEN 'banner-south' WHEN 2 THEN 'banner-east' "
            f"WHEN 3 THEN 'business-portal' ELSE 'banner-west' END")


# ---------------------------------------------------------------------------
# Adapter definitions, in dependency order.
# ---------------------------------------------------------------------------

def card_map(d: Dialect) -> str:
    return f"""
SELECT c_custkey AS HOUSEHOLD_ID,
       {_card('c_custkey')} AS LOYALTY_PROGRAM_CARD_NBR,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'i/ss' ELSE '1970-01-01' END AS BIRTH_DT,
       (c_custkey % 40 = 0) AS EMPLOYEE_IND
FROM {d.t('customer')}
"""


def txn_facts(d: Dialect) -> str:
    return f"""
SELECT l.l_orderkey AS TXN_ID,
       CAST(o.o_orderdate AS DATE) AS TXN_DTE,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'X' || CAST(o.o_custkey AS STRING) ELSE {_card('o.o_custkey')} END AS CARD_NBR,
       CAST(l.l_suppkey AS STRING) AS STORE_ID,
       l.l_partkey AS UPC_ID,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS GROSS_AMT,
       CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) - CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS NET_AMT,
       CAST(-(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS MKDN_AMT,
       CAST(CASE WHEN l.l_linestatus = 'O' THEN -(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2))) ELSE 0 END AS DECIMAL(18,4)) AS MKDN_WOD_ALLOC_AMT,
       CAST(CASE WHEN l.l_linestatus = 'F' THEN -(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2))) ELSE 0 END AS DECIMAL(18,4)) AS MKDN_POD_ALLOC_AMT,
       CAST(l.l_quantity AS DECIMAL(18,2)) AS ITEM_QTY,
       CAST(0 AS DECIMAL(18,2)) AS MEAS_QTY,
       CASE WHEN l.l_linenumber = 1 AND l.l_returnflag = 'R' THEN 1 ELSE 0 END AS MISC_ITEM_QTY,
       CASE WHEN l.l_linenumber = 5 AND l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 1 ELSE 0 END AS DEPOSIT_ITEM_QTY,
       CASE WHEN l.l_linenumber = 7 THEN 9 ELSE 0 END AS REV_DTL_SUBTYPE_ID,
       CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS TXN_HDR_SRC_CD
FROM {d.lines()}
"""


def txn_header(d: Dialect) -> str:
    return f"""
SELECT o_orderkey AS TXN_ID,
       CAST(o_orderdate AS DATE) AS TXN_DTE,
       CASE WHEN o_orderkey % 97 = 0 THEN 'X' || CAST(o_custkey AS STRING) ELSE {_card('o_custkey')} END AS CARD_NBR,
       CAST(o_orderkey % 100 AS STRING) AS STORE_ID,
       CASE o_orderpriority WHEN '1-URGENT' THEN 99 WHEN '2-HIGH' THEN 104
            WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 120 END
            WHEN '4-NOT SPECIFIED' THEN 23 ELSE 44 END AS REGISTER_NBR,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS TXN_HDR_SRC_CD,
       CAST(o_totalprice AS DECIMAL(18,2)) AS TOTAL_GROSS_AMT,
       CAST(CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 0.1 ELSE 0 END AS DECIMAL(18,4)) AS TENDER_AMT_FOODSTAMPS,
       CAST(CASE WHEN o_orderkey % 10 = 5 THEN CAST(o_totalprice AS DECIMAL(18,2)) * 0.05 ELSE 0 END AS DECIMAL(18,4)) AS TENDER_AMT_EBT
FROM {d.t('orders')}
"""


def calendar(d: Dialect) -> str:
    return f"""
SELECT {d.date_series('lo', 'hi')} AS D_DATE
FROM (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi FROM {d.t('orders')}) b
"""


def fiscal_week(d: Dialect) -> str:
    return f"""
SELECT {_week_id(d, 'D_DATE')} AS FISCAL_WEEK_ID,
       MIN(D_DATE) AS FISCAL_WEEK_START_DT,
       MIN(D_DATE) + 6 AS FISCAL_WEEK_END_DT
FROM {d.a('calendar')}
GROUP BY {_week_id(d, 'D_DATE')}
"""


def upc(d: Dialect) -> str:
    return f"""
SELECT p_partkey AS UPC_NBR,
       (p_partkey % 50 <> 49) AS OWN_BRAND_UPC_IND,
       '001' AS CORPORATION_ID,
       CASE WHEN p_partkey % 250 = 0 THEN 'N/A' ELSE CAST(330 + p_partkey % 20 AS STRING) END AS RETAIL_DEPARTMENT_ID,
       CAST(p_partkey % 100 AS INT) AS SMIC_GROUP_ID,
       p_size AS SMIC_CATEGORY_ID,
       'CAT ' || CAST(p_size AS STRING) AS SMIC_CATEGORY_DSC,
       p_type AS DEPARTMENT_NM,
       (p_partkey % 500 = 1) AS DW_LOGICAL_DELETE_IND
FROM {d.t('part')}
"""


def store(d: Dialect) -> str:
    return f"""
SELECT s.s_suppkey + 100000 AS FACILITY_INTEGRATION_ID,
       lpad(CAST(s.s_suppkey AS STRING), 4, '0') AS RETAIL_STORE_FACILITY_NBR,
       (s.s_suppkey % 50 = 49) AS DW_LOGICAL_DELETE_IND,
       CASE WHEN n.n_regionkey = 4 THEN 'N/A' ELSE r.r_name END AS PARENT_OPERATING_AREA_CD,
       s.s_nationkey AS DIVISION_ID,
       CASE WHEN s.s_nationkey = 24 THEN 'TEST' ELSE n.n_name END AS DIVISION_NM,
       lower(r.r_name) AS BANNER_NM
FROM {d.t('supplier')} s
JOIN {d.t('nation')} n ON s.s_nationkey = n.n_nationkey
JOIN {d.t('region')} r ON n.n_regionkey = r.r_regionkey
"""


def store_upc_agp(d: Dialect) -> str:
    return f"""
SELECT l.l_suppkey + 100000 AS FACILITY_INTEGRATION_ID,
       l.l_partkey AS UPC_NBR,
       CAST(o.o_orderdate AS DATE) AS TRANSACTION_DT,
       CASE WHEN l.l_partkey % 13 = 0 THEN NULL WHEN l.l_partkey % 17 = 0 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) END AS ITEM_QTY,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,4)) AS NET_AMT,
       CAST(NULL AS DECIMAL(18,4)) AS AGP_UNIT_AMT,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.70) AS DECIMAL(18,4)) AS COST_OF_GOODS_AMT,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.25) AS DECIMAL(18,4)) AS AGP_EXTENDED_AMT,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.01) AS DECIMAL(18,4)) AS RETAIL_LATE_FLAT_ALLOWANCE_AMT,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 0.02) AS DECIMAL(18,4)) AS RETAIL_NEW_ITEM_ALLOWANCE_AMT
FROM {d.lines()}
GROUP BY l.l_suppkey, l.l_partkey, CAST(o.o_orderdate AS DATE)
"""


def hits(d: Dialect) -> str:
    """Click hits.  Users divisible by 11 browse on two devices (event parity)."""
    dev = "CASE WHEN user_id % 11 = 0 THEN event_id % 2 ELSE 0 END"
    return f"""
SELECT ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE_TIME,
       ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DW_CREATETS,
       'V' AS POST_VISID_HIGH,
       CAST(user_id AS STRING) || '.' || CAST({dev} AS STRING) AS POST_VISID_LOW,
       '1' AS VISIT_NUM,
       CAST(CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS STRING) AS VISIT_START_TIME_GMT,
       {_card('user_id')} AS POST_EVAR46,
       CASE WHEN user_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN NULL
            WHEN event_id % 101 = 0 THEN 'ID not found' ELSE CAST(user_id AS STRING) END AS POST_EVAR47,
       'A' || CAST(user_id AS STRING) || '.' || CAST({dev} AS STRING) AS POST_EVAR49,
       {_banner('user_id')} AS POST_EVAR4,
       CASE WHEN user_id % 4 = 2 THEN 'web' ELSE 'app' END AS POST_EVAR90,
       CASE user_id % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE 'desktop' END AS POST_EVAR116,
       CASE event_type WHEN 'purchase' THEN 'order confirmation' WHEN 'view' THEN 'product detail' ELSE 'home' END AS POST_PAGENAME,
       CASE WHEN event_type = 'purchase' THEN 'checkout' ELSE NULL END AS POST_EVAR151,
       CAST(NULL AS STRING) AS POST_EVAR152,
       CAST(NULL AS STRING) AS POST_EVAR153,
       CASE event_type
            WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN '1,12' WHEN event_id % 4 = 1 THEN '200,12' ELSE '12' END
            WHEN 'signup' THEN '20305'
            WHEN 'error' THEN '200,112'
            WHEN 'view' THEN '112'
            ELSE '1' END AS POST_EVENT_LIST,
       'x9:1:0,{WEB_EXPERIMENT_ID}:' || CAST((user_id + {dev}) % 3 AS STRING) || ':0' AS POST_TNT,
       CASE WHEN event_id % 50 = 0 THEN '1' ELSE '0' END AS EXCLUDE_HIT,
       CASE WHEN event_id % 40 = 1 THEN '5' ELSE '1' END AS HIT_SOURCE
FROM {d.t('events')}
"""


def visits(d: Dialect) -> str:
    return f"""
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS STRING) AS VISIT_ID,
       'V' || CAST(user_id AS STRING) || '.0' AS VISITOR_ID,
       CASE WHEN user_id % 13 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS RETAIL_CUSTOMER_HHID_TXT,
       MIN(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY) AS VISIT_START_TS,
       MAX(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY) AS VISIT_END_TS,
       'A' || CAST(user_id AS STRING) || '.0' AS ADOBE_VISITOR_ID_TXT,
       CASE WHEN user_id % 13 = 0 THEN 0 ELSE 1 END AS SIGN_IN_IND,
       {_banner('user_id')} AS BANNER_NM_TXT,
       CASE user_id % 3 WHEN 0 THEN 'IOS_APP' WHEN 1 THEN 'ANDROID_APP' ELSE 'DESKTOP_WEB' END AS USER_OS_TYPE_CD,
       CASE WHEN user_id % 5 = 0 THEN 'home|order confirmation' ELSE 'home|search' END AS PAGES_VIEWED_TXT
FROM {d.t('events')}
GROUP BY user_id, CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE)
"""


def order_journey(d: Dialect) -> str:
    return f"""
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS STRING) AS VISIT_ID,
       CAST(event_id AS STRING) AS ORDER_ID,
       CAST(value AS DECIMAL(18,2)) AS GROSS_REVENUE_AMT,
       CAST(1 + event_id % 3 AS INT) AS GROSS_UNIT_CNT
FROM {d.t('events')}
WHERE event_type = 'purchase'
"""


def campaign_recipes(d: Dialect) -> str:
    """Campaign → recipe names, derived from the experiment tokens seen in the hits."""
    return f"""
SELECT DISTINCT CAST({WEB_EXPERIMENT_ID} AS INT) AS CAMPAIGN_ID,
       'EXP-20404 homepage banner test' AS CAMPAIGN_DSC,
       CASE (user_id + CASE WHEN user_id % 11 = 0 THEN event_id % 2 ELSE 0 END) % 3
            WHEN 0 THEN 'Control' WHEN 1 THEN 'Recipe B' ELSE 'Recipe C' END AS RECIPE_NM
FROM {d.t('events')}
"""


def session_events(d: Dialect) -> str:
    """Decision-engine session events: one per customer, a second variant for every 17th,
    a repeat of the same variant for every 5th, an invalid variant code for every 23rd."""
    base_ts = ("CAST(DATE '1997-01-01' + CAST(c_custkey % 180 AS INT) AS TIMESTAMP)"
               " + INTERVAL 1 HOUR * CAST(c_custkey % 24 AS INT)")
    return f"""
SELECT c_custkey AS HOUSEHOLD_ID, '{ENGINE_EXPERIMENT_ID}' AS DECISION_ENGINE_EXPERIMENT_ID,
       chr(CAST(65 + c_custkey % 3 AS INT)) AS DECISION_ENGINE_VARIANT_CD,
       {base_ts} - INTERVAL 1 HOUR * CAST(c_custkey % 3 AS INT) AS EVENT_TS,
       'pageLoaded' AS EVENT_TYPE_CD,
       CASE WHEN c_custkey % 4 = 0 THEN 'order confirmation' ELSE 'home' END AS EVENT_NM,
       {_banner('c_custkey')} AS BANNER_NM,
       CASE c_custkey % 4 WHEN 0 THEN 'appios-12.1' WHEN 1 THEN 'appand-12.1' ELSE NULL END AS APP_VERSION_CD
FROM {d.t('customer')}
UNION ALL
SELECT c_custkey, '{ENGINE_EXPERIMENT_ID}', chr(CAST(65 + (c_custkey + 1) % 3 AS INT)),
       {base_ts} + INTERVAL 2 DAY, 'pageLoaded', 'home', {_banner('c_custkey')}, NULL
FROM {d.t('customer')} WHERE c_custkey % 17 = 0
UNION ALL
SELECT c_custkey, '{ENGINE_EXPERIMENT_ID}', chr(CAST(65 + c_custkey % 3 AS INT)),
       {base_ts} + INTERVAL 1 DAY, 'pageLoaded', 'home', {_banner('c_custkey')}, NULL
FROM {d.t('customer')} WHERE c_custkey % 5 = 0
UNION ALL
SELECT c_custkey, '{ENGINE_EXPERIMENT_ID}', 'Z',
       {base_ts}, 'pageLoaded', 'home', {_banner('c_custkey')}, NULL
FROM {d.t('customer')} WHERE c_custkey % 23 = 0
"""


def household_list(d: Dialect) -> str:
    """Pre-assigned household list: every 17th household listed twice with two variants."""
    facts = "CASE c_custkey % 7 WHEN 0 THEN '1.Elite and Best' WHEN 1 THEN '2.Good' ELSE '3.Occasional' END"
    myneeds = "CASE c_custkey % 6 WHEN 0 THEN '1.Easy Shoppers' WHEN 1 THEN '2.Easy Eaters' ELSE '5.Chasing Price' END"
    return f"""
SELECT CAST(c_custkey AS STRING) AS HOUSEHOLD_ID, chr(CAST(65 + c_custkey % 3 AS INT)) AS VARIANT,
       {facts} AS TWELVE_WEEKS_FACTS, {myneeds} AS MYNEEDS
FROM {d.t('customer')}
UNION ALL
SELECT CAST(c_custkey AS STRING), chr(CAST(65 + (c_custkey + 1) % 3 AS INT)), {facts}, {myneeds}
FROM {d.t('customer')} WHERE c_custkey % 17 = 0
"""


def third_party_households(d: Dialect) -> str:
    return f"""
SELECT c_custkey AS HOUSEHOLD_ID FROM {d.t('customer')} WHERE c_custkey % 29 = 0
UNION ALL
SELECT CAST(NULL AS BIGINT) FROM {d.t('region')} WHERE r_regionkey = 0
"""


def hh_weekly_margin(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       {_week_id(d, 'CAST(o_orderdate AS DATE)')} AS WEEK_ID,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * 0.05) AS DECIMAL(18,4)) AS AGP_VAL_WITHOUT_INSTA_ADJ
FROM {d.t('orders')}
GROUP BY o_custkey, {_week_id(d, 'CAST(o_orderdate AS DATE)')}
"""


def offer_bank(d: Dialect) -> str:
    """Offer attributes; every 31st offer is missing from the bank, every 37th listed twice."""
    body = f"""
SELECT p_partkey AS OFFER_ID,
       CASE p_type WHEN 'PROMO' THEN 'PERSONALIZATION EXPERIMENT' WHEN 'ECONOMY' THEN 'CONTINUITY'
                   WHEN 'STANDARD' THEN 'REGULAR' ELSE 'OTHER' END AS PROGRAM_TYPE,
       CASE p_size % 5 WHEN 0 THEN 'Meat Seafood' WHEN 1 THEN 'MEAT' WHEN 2 THEN 'produce'
                       WHEN 3 THEN 'Bakery' ELSE 'SEAFOOD' END AS PROGRAM_SUBTYPE,
       CASE WHEN p_size % 2 = 0 THEN 'SPD' ELSE 'SC' END AS PROGRAM_CODE
FROM {d.t('part')}"""
    return f"""
{body} WHERE p_partkey % 31 <> 0
UNION ALL
{body} WHERE p_partkey % 37 = 0 AND p_partkey % 31 <> 0
"""


def clips_raw(d: Dialect) -> str:
    return f"""
SELECT o.o_custkey AS HOUSEHOLD_ID,
       l.l_partkey AS CLIENT_OFFER_ID,
       o.o_orderdate - INTERVAL 1 DAY + INTERVAL 1 HOUR * l.l_linenumber AS CLIP_TS,
       CAST(o.o_orderdate - INTERVAL 1 DAY AS DATE) AS CLIP_DT,
       {_offer_type('l.l_partkey')} AS OFFER_TYPE
FROM {d.lines()}
"""


def redemptions_raw(d: Dialect) -> str:
    g = "CAST(l.l_extendedprice AS DECIMAL(18,2))"
    return f"""
SELECT l.l_orderkey AS TXN_ID,
       o.o_custkey AS HOUSEHOLD_ID,
       CAST(o.o_orderdate AS DATE) AS TXN_DTE,
       l.l_partkey AS CLIENT_OFFER_ID,
       {_offer_type('l.l_partkey')} AS OFFER_TYPE,
       CAST(CASE WHEN o.o_orderpriority = '5-LOW' THEN l.l_quantity * 10 ELSE 0 END AS DECIMAL(18,2)) AS FUEL_REWARD_POINTS,
       CAST(-({g} * CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS MKDN_AMT,
       CAST(CASE WHEN l.l_linestatus = 'O' THEN -({g} * CAST(l.l_tax AS DECIMAL(4,2))) ELSE 0 END AS DECIMAL(18,4)) AS WOD_MKDN_AMT,
       CAST(CASE WHEN l.l_linestatus = 'F' THEN -({g} * CAST(l.l_tax AS DECIMAL(4,2))) ELSE 0 END AS DECIMAL(18,4)) AS POD_MKDN_AMT
FROM {d.lines()}
WHERE l.l_discount > 0
"""


def reward_transactions(d: Dialect) -> str:
    """Fuel reward ledger: one row per low-priority (fuel) order."""
    price = "CAST(o_totalprice AS DECIMAL(18,2))"
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       CAST(o_orderkey % 4 AS INT) AS BUSINESS_PARTNER_INTEGRATION_ID,
       CASE WHEN o_orderstatus = 'F' THEN 'EARN' ELSE 'REDREQ' END AS TRANSACTION_TYPE_CD,
       o_orderdate AS TRANSACTION_TS,
       CAST(-(1 + o_orderkey % 3) AS DECIMAL(18,2)) AS REWARD_TOKEN_OFFERED_QTY,
       CAST({price} * 0.001 AS DECIMAL(20,5)) AS TOTAL_SAVINGS_VALUE_AMT,
       CAST({price} * 0.00025 AS DECIMAL(22,7)) AS TOTAL_PURCHASE_QTY,
       CAST(o_orderkey % 20 AS STRING) AS PARTNER_DIVISION_ID,
       CASE WHEN o_orderkey % 9 = 0 THEN DATE '2000-01-01' ELSE DATE '9999-12-31' END AS DW_LAST_EFFECTIVE_DT
FROM {d.t('orders')}
WHERE o_orderpriority = '5-LOW'
"""


def business_partner(d: Dialect) -> str:
    return f"""
SELECT DISTINCT CAST(o_orderkey % 4 AS INT) AS BUSINESS_PARTNER_INTEGRATION_ID,
       CASE o_orderkey % 4 WHEN 1 THEN '3001' WHEN 2 THEN '3002' ELSE '9999' END AS PARTNER_ID,
       CAST(o_orderkey % 4 AS STRING) AS PARTNER_SITE_ID,
       DATE '9999-12-31' AS DW_LAST_EFFECTIVE_DT
FROM {d.t('orders')}
"""


def customer_profile(d: Dialect) -> str:
    return f"""
SELECT 'U' || CAST(c_custkey AS STRING) AS RETAIL_CUSTOMER_UUID,
       CAST(c_custkey AS STRING) AS HOUSEHOLD_ID,
       {_card('c_custkey')} AS CLUB_CARD_NBR,
       CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'i/ss' ELSE 'Customer' END AS FIRST_NM,
       CASE WHEN c_custkey % 8 = 0 THEN 'o9O' ELSE substr(c_name, 10) END AS LAST_NM,
       CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'O/zG' ELSE '555' || CAST(c_custkey AS STRING) END AS PHONE_NBR,
       CASE WHEN c_acctbal < 0 THEN 'N/A' ELSE CAST(10000 + c_nationkey AS STRING) END AS ZIPCODE,
       CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS PRIM_DIVISION_ID,
       (c_custkey % 45 = 0) AS EMPLOYEE_IND,
       (c_custkey % 97 <> 0) AS DW_CURRENT_VERSION_IND
FROM {d.t('customer')}
"""


def customer_first_event(d: Dialect) -> str:
    return f"""
SELECT 'U' || CAST(o_custkey AS STRING) AS RETAIL_CUSTOMER_UUID,
       MIN(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) END) AS FIRST_DUG_DT,
       MIN(CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS DATE) END) AS FIRST_DELIVERY_DT,
       FALSE AS DW_LOGICAL_DELETE_IND,
       TRUE AS DW_CURRENT_VERSION_IND
FROM {d.t('orders')}
GROUP BY o_custkey
"""


def digital_contact(d: Dialect) -> str:
    return f"""
SELECT 'U' || CAST(c_custkey AS STRING) AS RETAIL_CUSTOMER_UUID,
       CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN 'L/km'
            ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS EMAIL_ID,
       (c_custkey % 7 <> 3) AS DW_CURRENT_VERSION_IND
FROM {d.t('customer')}
"""


def phone_contact(d: Dialect) -> str:
    return f"""
SELECT 'U' || CAST(c_custkey AS STRING) AS RETAIL_CUSTOMER_UUID, TRUE AS DW_CURRENT_VERSION_IND
FROM {d.t('customer')} WHERE c_acctbal > -500
"""


def basket_grades(d: Dialect) -> str:
    return f"""
SELECT o_orderkey AS TXN_ID,
       CASE o_orderkey % 5 WHEN 0 THEN 'A - PERFECT' WHEN 1 THEN 'B - GREAT' WHEN 2 THEN 'C - ACCEPTABLE'
                           WHEN 3 THEN 'D - NEEDS_IMPROVEMENT' ELSE 'E - POOR' END AS OVERALL_CATEGORY
FROM {d.t('orders')}
"""


def txn_segments(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HHS_ID,
       CAST(o_orderdate AS DATE) AS TXN_DTE,
       o_orderkey AS TXN_ID,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'BNC TO ECOMM' WHEN o_orderstatus = 'P' THEN NULL
            ELSE 'EXISTING' END AS SEGMENT_1
FROM {d.t('orders')}
"""


def push_population(d: Dialect) -> str:
    return f"SELECT CAST(c_custkey AS STRING) AS HOUSEHOLD_ID FROM {d.t('customer')} WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')"


def email_population(d: Dialect) -> str:
    return f"SELECT CAST(c_custkey AS STRING) AS HOUSEHOLD_ID FROM {d.t('customer')} WHERE c_acctbal > 0"


def sms_population(d: Dialect) -> str:
    return f"SELECT CAST(c_custkey AS STRING) AS HOUSEHOLD_ID FROM {d.t('customer')} WHERE c_mktsegment = 'HOUSEHOLD'"


def hh_engagement_weekly(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       {_week_id(d, 'CAST(o_orderdate AS DATE)')} AS FISCAL_WEEK_ID,
       CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS GR_REDEMPTIONS,
       CAST(SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS GAS_REDEMPTIONS
FROM {d.t('orders')}
GROUP BY o_custkey, {_week_id(d, 'CAST(o_orderdate AS DATE)')}
"""


def facts_segment_week(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       {_week_id(d, 'CAST(o_orderdate AS DATE)')} AS WEEK_ID,
       CASE WHEN MIN(o_orderkey) % 11 = 0 THEN NULL ELSE CAST(1 + MIN(o_orderkey) % 6 AS INT) END AS FACTS_LEVEL2_SEGMENT_ID
FROM {d.t('orders')}
GROUP BY o_custkey, {_week_id(d, 'CAST(o_orderdate AS DATE)')}
"""


def attitudinal_segments(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       CAST(1 + MAX(o_orderkey) % 6 AS INT) AS SEGMENT,
       CAST(year(o_orderdate) AS INT) * 100 + 1 AS START_WEEK_ID
FROM {d.t('orders')}
GROUP BY o_custkey, year(o_orderdate)
"""


def hh_primary_store(d: Dialect) -> str:
    return f"""
SELECT CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       CAST(year(o_orderdate) AS STRING) AS PGM_PERIOD_ID,
       CAST(MIN(o_orderkey) % 120 AS STRING) AS PRIM_STORE_ID
FROM {d.t('orders')}
GROUP BY o_custkey, year(o_orderdate)
"""


def points_header(d: Dialect) -> str:
    return f"""
SELECT CAST(o_orderkey AS STRING) AS TRANSACTION_INTEGRATION_ID,
       CAST(o_custkey AS STRING) AS HOUSEHOLD_ID,
       o_orderdate + INTERVAL 10 HOUR AS TRANSACTION_TS
FROM {d.t('orders')}
"""


def points(d: Dialect) -> str:
    return f"""
SELECT CAST(l_orderkey AS STRING) AS TRANSACTION_INTEGRATION_ID,
       CASE WHEN l_linenumber = 1 THEN 44646442 WHEN l_linenumber = 2 THEN 90120515 ELSE l_partkey END AS OFFER_ID,
       CAST(l_quantity AS BIGINT) * 10 AS POINTS_EARNED_NBR,
       (l_returnflag <> 'R') AS DW_CURRENT_VERSION_IND,
       FALSE AS DW_LOGICAL_DELETE_IND
FROM {d.t('lineitem')}
"""


ADAPTERS: dict[str, Callable[[Dialect], str]] = {
    "card_map": card_map,
    "txn_facts": txn_facts,
    "txn_header": txn_header,
    "calendar": calendar,
    "fiscal_week": fiscal_week,
    "upc": upc,
    "store": store,
    "store_upc_agp": store_upc_agp,
    "hits": hits,
    "visits": visits,
    "order_journey": order_journey,
    "campaign_recipes": campaign_recipes,
    "session_events": session_events,
    "household_list": household_list,
    "third_party_households": third_party_households,
    "hh_weekly_margin": hh_weekly_margin,
    "offer_bank": offer_bank,
    "clips_raw": clips_raw,
    "redemptions_raw": redemptions_raw,
    "reward_transactions": reward_transactions,
    "business_partner": business_partner,
    "customer_profile": customer_profile,
    "customer_first_event": customer_first_event,
    "digital_contact": digital_contact,
    "phone_contact": phone_contact,
    "basket_grades": basket_grades,
    "txn_segments": txn_segments,
    "push_population": push_population,
    "email_population": email_population,
    "sms_population": sms_population,
    "hh_engagement_weekly": hh_engagement_weekly,
    "facts_segment_week": facts_segment_week,
    "attitudinal_segments": attitudinal_segments,
    "hh_primary_store": hh_primary_store,
    "points_header": points_header,
    "points": points,
}


def duckdb_ctes() -> str:
    """All adapters as a DuckDB ``WITH`` prefix (the driver pre-registers the base tables as views)."""
    d = DuckDialect(table_ref=lambda n: n, adapter_ref=lambda n: n)
    parts = [f"{name} AS ({fn(d).strip()})" for name, fn in ADAPTERS.items()]
    return "WITH " + ",\n".join(parts) + "\n"


#: Columns of lines and orders that the adapters over both read.
LINE_COLUMNS = {
    "l": ("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
    "o": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
}
#: A clip is dated the day before its order, so the lines of a window reach one day beyond it.
DAYS_AFTER = 1


class Domain:
    """Spark side: domain tables over the parquet files of one scale-factor folder.

    Each adapter becomes a temporary view whose name is unique to the folder,
    so several scale factors can live in one session.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.tag = hashlib.sha1(self.sf_dir.encode()).hexdigest()[:8]
        self._made: set[str] = set()
        # Timestamps in the test tables are wall-clock values; read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._dialect = Dialect(
            table_ref=lambda n: f"parquet.`{self.sf_dir}/{n}.parquet`",
            adapter_ref=self._view,
        )

    def keep_lines(self, first: str, last: str) -> "Domain":
        """The same tables for readers of the days from ``first`` to ``last``: the lines of these days are joined to their
        orders and written once to the shared checkpoint folder, where each table over lines and orders reads them.

        Every such table filters its days after the join, so otherwise all lines are shuffled again for each of them.
        """
        names = [f"{side}.{c}" for side, own in LINE_COLUMNS.items() for c in own]
        joined = self.spark.sql(
            f"SELECT {', '.join(names)} FROM {self._dialect.lines()} WHERE CAST(o.o_orderdate AS DATE) "
            f"BETWEEN DATE '{first}' AND date_add(DATE '{last}', {DAYS_AFTER})")
        kept = Domain(self.spark, self.sf_dir)
        kept.tag = f"{self.tag}_{uuid.uuid4().hex[:8]}"
        view = f"xk_{kept.tag}_lines"
        sinks.store(joined).select(*[F.struct(*own).alias(side) for side, own in LINE_COLUMNS.items()]).createOrReplaceTempView(view)
        kept._dialect = KeptLinesDialect(self._dialect.t, kept._view, view)
        return kept

    def _view(self, name: str) -> str:
        view = f"xk_{self.tag}_{name}"
        if name not in self._made:
            sql = ADAPTERS[name](self._dialect)
            self.spark.sql(sql).createOrReplaceTempView(view)
            self._made.add(name)
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._view(name))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            return self.table(name)
        raise AttributeError(name)
