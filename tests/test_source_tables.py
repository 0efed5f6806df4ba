"""The contract of mapped source tables, and results through the mapping."""

import pytest
from pyspark.sql import types as T

from expkit.operators import builders as B
from expkit.plans.catalog import WINDOW
from expkit.sources.adapters import ADAPTERS, Domain
from expkit.sources.tables import CONTRACT, Source, SourceError, SourceTables, fits

NEEDED = ("txn_facts", "txn_header", "calendar", "card_map")


@pytest.fixture
def renamed(spark, sf_dir):
    """Views with warehouse column names and one column more."""
    d, sources = Domain(spark, sf_dir), {}
    for name in NEEDED:
        columns = {c: f"w_{c.lower()}" for c in d.table(name).columns}
        d.table(name).withColumnsRenamed(columns).selectExpr("*", "1 AS loaded").createOrReplaceTempView(f"wh_{name}")
        sources[name] = Source(f"wh_{name}", columns)
    return sources


def test_combined_txns_through_renamed_tables(spark, sf_dir, renamed):
    got = B.combined_txns(SourceTables(spark, renamed), WINDOW)
    want = B.combined_txns(Domain(spark, sf_dir), WINDOW)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_all_findings_come_at_once_and_before_any_plan(spark, renamed):
    spark.sql("SELECT w_txn_id, w_txn_dte, CAST(w_register_nbr AS STRING) w_register_nbr FROM wh_txn_header").createOrReplaceTempView("wh_bad")
    bad = {**renamed, "txn_header": Source("wh_bad", renamed["txn_header"].columns), "calendar": Source("wh_nowhere"), "no_such": Source("wh_calendar")}
    with pytest.raises(SourceError) as e:
        SourceTables(spark, bad)
    found = e.value.problems
    assert "txn_header: wh_bad has no column w_card_nbr" in found
    assert "txn_header: wh_bad.w_register_nbr is string, not int" in found
    assert any(p.startswith("calendar: wh_nowhere can't be read (TABLE_OR_VIEW_NOT_FOUND") for p in found)
    assert "no_such: no domain table of that name" in found


def test_a_renamed_column_outside_the_contract_is_a_finding(spark, renamed):
    with pytest.raises(SourceError, match="calendar: column D_DAY is not in the contract"):
        SourceTables(spark, {"calendar": Source("wh_calendar", {"D_DATE": "w_d_date", "D_DAY": "w_d_date"})})


def test_an_unmapped_table_stops_when_asked_for(spark, renamed):
    tables = SourceTables(spark, renamed)
    assert tables.calendar.columns == ["D_DATE"]
    with pytest.raises(SourceError, match="hits: no table is mapped"):
        tables.table("hits")
    with pytest.raises(AttributeError):
        tables.nothing_of_the_kind


def test_folders_names_of_either_case_and_narrower_types(spark, tmp_path):
    spark.sql("SELECT CAST(7 AS SMALLINT) AS fiscal_week_id, DATE'1997-01-05' AS Fiscal_Week_Start_Dt, DATE'1997-01-11' AS FISCAL_WEEK_END_DT").write.parquet(str(tmp_path / "weeks"))
    got = SourceTables(spark, {"fiscal_week": Source(str(tmp_path / "weeks"), format="parquet")}).fiscal_week
    assert got.schema.simpleString() == "struct<FISCAL_WEEK_ID:int,FISCAL_WEEK_START_DT:date,FISCAL_WEEK_END_DT:date>"
    assert got.first()["FISCAL_WEEK_ID"] == 7


def test_only_types_that_lose_nothing_fit():
    assert fits(T.IntegerType(), T.LongType()) and not fits(T.LongType(), T.IntegerType())
    assert fits(T.DecimalType(18, 2), T.DecimalType(18 + 2, 4)) and not fits(T.DecimalType(18, 2), T.DecimalType(18, 4))
    assert fits(T.IntegerType(), T.DecimalType(14, 4)) and not fits(T.LongType(), T.DecimalType(18, 4))
    assert not fits(T.StringType(), T.LongType()) and not fits(T.TimestampType(), T.TimestampNTZType())


def test_the_adapters_meet_the_contract(spark, sf_dir):
    d = Domain(spark, sf_dir)
    assert set(CONTRACT) == set(ADAPTERS)
    for name in CONTRACT:
        d.table(name).createOrReplaceTempView(f"own_{name}")
    SourceTables(spark, {name: f"own_{name}" for name in CONTRACT})
