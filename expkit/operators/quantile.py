"""Exact quantiles of large columns by counting refinement (M07 with ``percentile_disc``).

The value of rank k lies somewhere between the least and the greatest.  That range is cut into equal buckets, the rows of
each are counted, and the bucket that holds rank k becomes the next range, until one value is left.  A round is one pass
with partial counts and brings at most ``BUCKETS`` rows a column to the driver, whatever the number of rows; 64-bit
values need at most seven rounds, prices of a real table two or three.  Several columns are refined in the same passes.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Values are whole numbers of 1 / 10^SCALE.
SCALE = 4


def exact_quantiles(df: DataFrame, columns: dict[str, str], q: float) -> dict[str, Decimal | None]:
    """For each name the least value of its column that at least the share ``q`` of its known values doesn't exceed.

    Columns are whole or decimal numbers with up to ``SCALE`` decimals (finer ones are refused); a column without
    known values has the quantile None.
    """
    if not 0 < q <= 1:
        raise ValueError("q must be in (0, 1]")
    names = list(columns)
    exact = [F.col(columns[n]).cast("decimal(38,12)") * 10**SCALE for n in names]
    whole = df.select(*(F.floor(v).cast("long").alias(f"_{i}") for i, v in enumerate(exact)),
                      *(F.coalesce(v != F.floor(v), F.lit(False)).alias(f"_fine{i}") for i, v in enumerate(exact)))
    pairs = ", ".join(f"{i}, _{i}" for i in range(len(names)))
    seen = whole.agg(*(a.alias(f"{k}{i}") for i in range(len(names)) for k, a in (
        ("n", F.count(f"_{i}")), ("lo", F.min(f"_{i}")), ("hi", F.max(f"_{i}")), ("fine", F.max(f"_fine{i}"))))).first()
    if any(seen[f"fine{i}"] for i in range(len(names))):
        raise ValueError(f"values have more than {SCALE} decimals")
    long = whole.selectExpr(f"stack({len(names)}, {pairs}) AS (which, v)").where("v IS NOT NULL")

    # Rank wanted, counted from the start of the present range.
    rank = {i: max(1, math.ceil(Fraction(str(q)) * seen[f"n{i}"])) for i in range(len(names)) if seen[f"n{i}"]}
    bounds = {i: (seen[f"lo{i}"], seen[f"hi{i}"]) for i in rank}
    while open_ := {i: b for i, b in bounds.items() if b[0] < b[1]}:
        width = {i: -(-(hi - lo + 1) // BUCKETS) for i, (lo, hi) in open_.items()}
        inside, bucket = F.lit(False), None
        for i, (lo, hi) in open_.items():
            here = (F.col("which") == i) & F.col("v").between(lo, hi)
            inside = inside | here
            place = F.floor((F.col("v") - F.lit(lo)) / F.lit(width[i])) if hi - lo < 1 << 52 else F.expr(f"cast((cast(v as decimal(38,0)) - {lo}) div {width[i]} as long)")
            bucket = F.when(here, place) if bucket is None else bucket.when(here, place)
        counts: dict[int, list] = {i: [] for i in open_}
        for r in long.where(inside).groupBy("which", bucket.cast("long").alias("bucket")).count().collect():
            counts[r["which"]].append((r["bucket"], r["count"]))
        for i, (lo, hi) in open_.items():
            for b, n in sorted(counts[i]):
                if rank[i] <= n:
                    bounds[i] = (lo + b * width[i], min(hi, lo + (b + 1) * width[i] - 1))
                    break
                rank[i] -= n
    return {n: Decimal(bounds[i][0]).scaleb(-SCALE) if i in bounds else None for i, n in enumerate(names)}
