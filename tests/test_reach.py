"""Daily bitmaps against distinct counts by hand."""

import datetime
import random

import pytest

from expkit.operators import reach as U

SCHEMA = "VARIANT_ID string, EXPOSURE_DATETIME date, unit string"


def rows_of(seed, n=600, first=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["VARIANT A", "VARIANT B", None]), datetime.date(2024, 1, first + rng.randint(0, 9)), f"u{rng.randint(0, 150)}") for _ in range(n)]
    return rows + rows[:20] + [("VARIANT A", datetime.date(2024, 1, first), None)]


def by_hand(rows):
    rows = [r for r in rows if r[2] is not None]
    out = []
    for v in {r[0] for r in rows}:
        seen = set()
        for day in sorted({r[1] for r in rows if r[0] == v}):
            now = {r[2] for r in rows if r[0] == v and r[1] == day}
            out.append((v, day, len(now), len(now - seen), len(now | seen)))
            seen |= now
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.VARIANT_ID, r.EXPOSURE_DATETIME, r.distinct_units, r.new_units, r.distinct_to_date) for r in df.collect()), key=str)


def test_running_distincts_equal_those_by_hand(spark):
    rows = rows_of(1)
    exposure = spark.createDataFrame(rows, SCHEMA)
    numbers = U.unit_numbers(exposure, "unit")
    assert collected(U.running_distinct(U.daily_bitmaps(exposure, numbers, "unit"))) == by_hand(rows)


def test_a_later_delivery_merges(spark):
    old, new = rows_of(2), rows_of(3, first=6)
    first, second = (spark.createDataFrame(r, SCHEMA) for r in (old, new))
    numbers = U.unit_numbers(first, "unit")
    more = U.unit_numbers(second, "unit", numbers)
    kept = {r.unit: r.NUMBER for r in numbers.collect()}
    all_numbers = {r.unit: r.NUMBER for r in more.collect()}
    assert kept.items() <= all_numbers.items() and len(set(all_numbers.values())) == len(all_numbers)
    state = U.merged(U.daily_bitmaps(first, numbers, "unit"), U.daily_bitmaps(second, more, "unit"))
    assert collected(U.running_distinct(state)) == by_hand(old + new)
    again = U.merged(state, U.daily_bitmaps(second, more, "unit"))
    assert collected(U.running_distinct(again)) == by_hand(old + new)


def test_units_in_more_than_one_bitmap(spark):
    numbers = spark.range(0, 100_000, 1, 3).selectExpr("CAST(id AS STRING) AS unit", "id AS NUMBER")
    exposure = numbers.selectExpr("'VARIANT A' AS VARIANT_ID", "DATE'2024-01-01' AS EXPOSURE_DATETIME", "unit")
    got = U.running_distinct(U.daily_bitmaps(exposure, numbers, "unit")).first()
    assert (got.distinct_units, got.new_units, got.distinct_to_date) == (100_000,) * 3


@pytest.mark.parametrize("known", [False, True])
def test_nothing(spark, known):
    nothing = spark.createDataFrame([], SCHEMA)
    numbers = U.unit_numbers(nothing, "unit")
    if known:
        numbers = U.unit_numbers(spark.createDataFrame(rows_of(4), SCHEMA), "unit", numbers)
        assert numbers.count() > 0
    assert U.running_distinct(U.daily_bitmaps(nothing, numbers, "unit")).count() == 0
