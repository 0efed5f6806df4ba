"""Exact running numbers of distinct units, from daily bitmaps that merge.

Units get dense numbers once; a day's units of a variant are bitmaps of 32 768
numbers each.  Bitmaps of disjoint or overlapping sets of exposures merge by OR, so
a new day adds its own and nothing is counted again.  A running distinct is the
union up to a date, beside the published running sum of daily distincts, which
counts a unit again on each day it returns.

Rows without a unit take no part; a missing variant is a variant of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from expkit.operators.metrics import stored_units

KEYS = ("VARIANT_ID", "EXPOSURE_DATETIME")


def unit_numbers(units: DataFrame, unit_col: str, known: DataFrame | None = None) -> DataFrame:
    """(unit, NUMBER): dense within each partition, stored so that they stay; ``known`` ones keep their numbers."""
    new = units.select(unit_col).where(F.col(unit_col).isNotNull()).distinct()
    if known is None:
        return stored_units(new.withColumn("NUMBER", F.monotonically_increasing_id()))
    top = known.agg(F.max("NUMBER").alias("top")).scalar()
    # Whole bitmaps apart from the numbers given before.
    first = (F.floor(F.coalesce(top, F.lit(-1)) / 32768) + 1).cast("long") * 32768
    new = new.join(known, unit_col, "left_anti").withColumn("NUMBER", first + F.monotonically_increasing_id())
    return stored_units(known.unionByName(new))


def daily_bitmaps(exposure: DataFrame, numbers: DataFrame, unit_col: str) -> DataFrame:
    """One row a variant, day and 32 768 numbers: (VARIANT_ID, EXPOSURE_DATETIME, BUCKET, BITMAP)."""
    rows = exposure.select(*KEYS, unit_col).join(numbers, unit_col)
    return (rows.groupBy(*KEYS, F.bitmap_bucket_number("NUMBER").alias("BUCKET"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("NUMBER")).alias("BITMAP")))


def merged(*bitmaps: DataFrame) -> DataFrame:
    """The bitmaps of several sets of exposures as those of their union."""
    rows = bitmaps[0]
    for more in bitmaps[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*KEYS, "BUCKET").agg(F.bitmap_or_agg("BITMAP").alias("BITMAP"))


def running_distinct(bitmaps: DataFrame) -> DataFrame:
    """Per variant and date: distinct units of the day, units never seen before, and distinct units to date."""
    # A window holds one bitmap a date; a bucket adds what its union grew by.
    so_far = Window.partitionBy("VARIANT_ID", "BUCKET").orderBy("EXPOSURE_DATETIME").rowsBetween(Window.unboundedPreceding, 0)
    by_date = Window.partitionBy("VARIANT_ID", "BUCKET").orderBy("EXPOSURE_DATETIME")
    rows = bitmaps.select(*KEYS, "BUCKET", F.bitmap_count("BITMAP").alias("DAY"), F.bitmap_count(F.bitmap_or_agg("BITMAP").over(so_far)).alias("UNION"))
    grown = rows.withColumn("NEW", F.col("UNION") - F.coalesce(F.lag("UNION").over(by_date), F.lit(0)))
    daily = grown.groupBy(*KEYS).agg(F.sum("DAY").alias("distinct_units"), F.sum("NEW").alias("new_units"))
    to_date = Window.partitionBy("VARIANT_ID").orderBy("EXPOSURE_DATETIME").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("distinct_to_date", F.sum("new_units").over(to_date))
