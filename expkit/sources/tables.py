"""Domain tables from a warehouse: names, renamed columns, and a contract checked before planning.

``SourceTables`` stands wherever the operators take ``Domain``: it maps a domain
name to a table of the session's catalog or to a Parquet folder, gives columns
their domain names, and reads only those of the contract.  Every mapped table is
resolved when the object is made, from metadata alone; all that is missing or of
another type is reported in one error, before any job or plan of an analysis.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns that the operators read of each domain table, and their types.
CONTRACT: dict[str, str] = {
    "card_map": "HOUSEHOLD_ID bigint, LOYALTY_PROGRAM_CARD_NBR string, BIRTH_DT string, EMPLOYEE_IND boolean",
    "txn_facts": (
        "TXN_ID bigint, TXN_DTE date, CARD_NBR string, STORE_ID string, UPC_ID bigint, GROSS_AMT decimal(18,2), NET_AMT "
        "decimal(18,4), MKDN_AMT decimal(18,4), MKDN_WOD_ALLOC_AMT decimal(18,4), MKDN_POD_ALLOC_AMT decimal(18,4), "
        "ITEM_QTY decimal(18,2), MEAS_QTY decimal(18,2), MISC_ITEM_QTY int, DEPOSIT_ITEM_QTY int, REV_DTL_SUBTYPE_ID int, "
        "TXN_HDR_SRC_CD int"
    ),
    "txn_header": (
        "TXN_ID bigint, TXN_DTE date, CARD_NBR string, STORE_ID string, REGISTER_NBR int, TXN_HDR_SRC_CD int, "
        "TOTAL_GROSS_AMT decimal(18,2), TENDER_AMT_FOODSTAMPS decimal(18,4), TENDER_AMT_EBT decimal(18,4)"
    ),
    "calendar": "D_DATE date",
    "fiscal_week": "FISCAL_WEEK_ID int, FISCAL_WEEK_START_DT date, FISCAL_WEEK_END_DT date",
    "upc": (
        "UPC_NBR bigint, OWN_BRAND_UPC_IND boolean, CORPORATION_ID string, RETAIL_DEPARTMENT_ID string, SMIC_GROUP_ID "
        "int, SMIC_CATEGORY_ID int, SMIC_CATEGORY_DSC string, DEPARTMENT_NM string, DW_LOGICAL_DELETE_IND boolean"
    ),
    "store": (
        "FACILITY_INTEGRATION_ID bigint, RETAIL_STORE_FACILITY_NBR string, DW_LOGICAL_DELETE_IND boolean, "
        "PARENT_OPERATING_AREA_CD string, DIVISION_ID int, DIVISION_NM string, BANNER_NM string"
    ),
    "store_upc_agp": (
        "FACILITY_INTEGRATION_ID bigint, UPC_NBR bigint, TRANSACTION_DT date, ITEM_QTY decimal(18,2), NET_AMT "
        "decimal(18,4), AGP_UNIT_AMT decimal(18,4), COST_OF_GOODS_AMT decimal(18,4), AGP_EXTENDED_AMT decimal(18,4), "
        "RETAIL_LATE_FLAT_ALLOWANCE_AMT decimal(18,4), RETAIL_NEW_ITEM_ALLOWANCE_AMT decimal(18,4)"
    ),
    "hits": (
        "DATE_TIME timestamp_ntz, DW_CREATETS timestamp_ntz, POST_VISID_HIGH string, POST_VISID_LOW string, VISIT_NUM "
        "string, VISIT_START_TIME_GMT string, POST_EVAR46 string, POST_EVAR47 string, POST_EVAR49 string, POST_EVAR4 "
        "string, POST_EVAR90 string, POST_EVAR116 string, POST_PAGENAME string, POST_EVAR151 string, POST_EVAR152 string, "
        "POST_EVAR153 string, POST_EVENT_LIST string, POST_TNT string, EXCLUDE_HIT string, HIT_SOURCE string"
    ),
    "visits": (
        "VISIT_ID string, VISITOR_ID string, RETAIL_CUSTOMER_HHID_TXT string, VISIT_START_TS timestamp_ntz, VISIT_END_TS "
        "timestamp_ntz, ADOBE_VISITOR_ID_TXT string, SIGN_IN_IND int, BANNER_NM_TXT string, USER_OS_TYPE_CD string, "
        "PAGES_VIEWED_TXT string"
    ),
    "order_journey": "VISIT_ID string, ORDER_ID string, GROSS_REVENUE_AMT decimal(18,2), GROSS_UNIT_CNT int",
    "campaign_recipes": "CAMPAIGN_ID int, CAMPAIGN_DSC string, RECIPE_NM string",
    "session_events": (
        "HOUSEHOLD_ID bigint, DECISION_ENGINE_EXPERIMENT_ID string, DECISION_ENGINE_VARIANT_CD string, EVENT_TS "
        "timestamp, EVENT_TYPE_CD string, EVENT_NM string, BANNER_NM string, APP_VERSION_CD string"
    ),
    "household_list": "HOUSEHOLD_ID string, VARIANT string, TWELVE_WEEKS_FACTS string, MYNEEDS string",
    "third_party_households": "HOUSEHOLD_ID bigint",
    "hh_weekly_margin": "HOUSEHOLD_ID string, WEEK_ID int, AGP_VAL_WITHOUT_INSTA_ADJ decimal(18,4)",
    "offer_bank": "OFFER_ID bigint, PROGRAM_TYPE string, PROGRAM_SUBTYPE string, PROGRAM_CODE string",
    "clips_raw": "HOUSEHOLD_ID bigint, CLIENT_OFFER_ID bigint, CLIP_TS timestamp_ntz, CLIP_DT date, OFFER_TYPE string",
    "redemptions_raw": (
        "TXN_ID bigint, HOUSEHOLD_ID bigint, TXN_DTE date, CLIENT_OFFER_ID bigint, OFFER_TYPE string, FUEL_REWARD_POINTS "
        "decimal(18,2), MKDN_AMT decimal(18,4), WOD_MKDN_AMT decimal(18,4), POD_MKDN_AMT decimal(18,4)"
    ),
    "reward_transactions": (
        "HOUSEHOLD_ID string, BUSINESS_PARTNER_INTEGRATION_ID int, TRANSACTION_TYPE_CD string, TRANSACTION_TS "
        "timestamp_ntz, REWARD_TOKEN_OFFERED_QTY decimal(18,2), TOTAL_SAVINGS_VALUE_AMT decimal(20,5), TOTAL_PURCHASE_QTY "
        "decimal(22,7), PARTNER_DIVISION_ID string, DW_LAST_EFFECTIVE_DT date"
    ),
    "business_partner": "BUSINESS_PARTNER_INTEGRATION_ID int, PARTNER_ID string, PARTNER_SITE_ID string, DW_LAST_EFFECTIVE_DT date",
    "customer_profile": (
        "RETAIL_CUSTOMER_UUID string, HOUSEHOLD_ID string, CLUB_CARD_NBR string, FIRST_NM string, LAST_NM string, "
        "PHONE_NBR string, ZIPCODE string, PRIM_DIVISION_ID string, EMPLOYEE_IND boolean, DW_CURRENT_VERSION_IND boolean"
    ),
    "customer_first_event": (
        "RETAIL_CUSTOMER_UUID string, FIRST_DUG_DT date, FIRST_DELIVERY_DT date, DW_LOGICAL_DELETE_IND boolean, "
        "DW_CURRENT_VERSION_IND boolean"
    ),
    "digital_contact": "RETAIL_CUSTOMER_UUID string, EMAIL_ID string, DW_CURRENT_VERSION_IND boolean",
    "phone_contact": "RETAIL_CUSTOMER_UUID string, DW_CURRENT_VERSION_IND boolean",
    "basket_grades": "TXN_ID bigint, OVERALL_CATEGORY string",
    "txn_segments": "HHS_ID string, TXN_DTE date, TXN_ID bigint, SEGMENT_1 string",
    "push_population": "HOUSEHOLD_ID string",
    "email_population": "HOUSEHOLD_ID string",
    "sms_population": "HOUSEHOLD_ID string",
    "hh_engagement_weekly": "HOUSEHOLD_ID string, FISCAL_WEEK_ID int, GR_REDEMPTIONS bigint, GAS_REDEMPTIONS bigint",
    "facts_segment_week": "HOUSEHOLD_ID string, WEEK_ID int, FACTS_LEVEL2_SEGMENT_ID int",
    "attitudinal_segments": "HOUSEHOLD_ID string, SEGMENT int, START_WEEK_ID int",
    "hh_primary_store": "HOUSEHOLD_ID string, PGM_PERIOD_ID string, PRIM_STORE_ID string",
    "points_header": "TRANSACTION_INTEGRATION_ID string, HOUSEHOLD_ID string, TRANSACTION_TS timestamp_ntz",
    "points": (
        "TRANSACTION_INTEGRATION_ID string, OFFER_ID bigint, POINTS_EARNED_NBR bigint, DW_CURRENT_VERSION_IND boolean, "
        "DW_LOGICAL_DELETE_IND boolean"
    ),
}

#: Integral types by width.
_WIDTH = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


class SourceError(ValueError):
    """What the mapped tables lack; ``problems`` lists each finding."""

    def __init__(self, problems: list[str]):
        super().__init__("source tables don't meet the contract:\n" + "\n".join(f"- {p}" for p in problems))
        self.problems = problems


@dataclass(frozen=True)
class Source:
    """Where a domain table is: a catalog name, or a folder with ``format``; ``columns`` maps domain to source names."""

    name: str
    columns: Mapping[str, str] = field(default_factory=dict)
    format: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name) if self.format is None else spark.read.format(self.format).load(self.name)


def fits(have: T.DataType, want: T.DataType) -> bool:
    """Whether every value of one type is a value of the other: equal types, wider integers, wider decimals."""
    if have == want:
        return True
    if type(have) in _WIDTH and type(want) in _WIDTH:
        return _WIDTH[type(have)] <= _WIDTH[type(want)]
    if isinstance(want, T.DecimalType):
        if type(have) in _WIDTH:
            return _WIDTH[type(have)] <= want.precision - want.scale
        return isinstance(have, T.DecimalType) and have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale
    return False


class SourceTables:
    """Domain tables read through a mapping of names.

    A table that isn't mapped is an error when it is asked for, not before, so a
    run needs only the tables of its families.  Columns beside the contract's are
    not read; source names are matched as the session matches names.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source | str], contract: Mapping[str, str] = CONTRACT):
        self.spark = spark
        self._sources = {n: Source(s) if isinstance(s, str) else s for n, s in sources.items()}
        self._tables: dict[str, DataFrame] = {}
        problems: list[str] = []
        for name, source in self._sources.items():
            if name not in contract:
                problems.append(f"{name}: no domain table of that name")
                continue
            want = T.StructType.fromDDL(contract[name])
            problems += [f"{name}: column {c} is not in the contract" for c in source.columns if c not in want.names]
            try:
                found = source.read(spark)
            except AnalysisException as e:
                problems.append(f"{name}: {source.name} can't be read ({e.getCondition()})")
                continue
            self._tables[name] = self._renamed(name, source, found, want, problems)
        if problems:
            raise SourceError(problems)

    def _renamed(self, name: str, source: Source, found: DataFrame, want: T.StructType, problems: list[str]) -> DataFrame:
        same = self.spark.conf.get("spark.sql.caseSensitive") == "true"
        have = {f.name if same else f.name.lower(): f for f in found.schema.fields}
        columns = []
        for f in want.fields:
            own = source.columns.get(f.name, f.name)
            there = have.get(own if same else own.lower())
            if there is None:
                problems.append(f"{name}: {source.name} has no column {own}")
            elif not fits(there.dataType, f.dataType):
                problems.append(f"{name}: {source.name}.{own} is {there.dataType.simpleString()}, not {f.dataType.simpleString()}")
            else:
                columns.append(found[f"`{there.name}`"].cast(f.dataType).alias(f.name))
        return found.select(*columns) if columns else found.select(F.lit(None).alias("none"))

    def table(self, name: str) -> DataFrame:
        try:
            return self._tables[name]
        except KeyError:
            raise SourceError([f"{name}: no table is mapped to it"]) from None

    def __getattr__(self, name: str) -> DataFrame:
        if name in CONTRACT:
            return self.table(name)
        raise AttributeError(name)
