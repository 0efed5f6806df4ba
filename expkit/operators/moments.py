"""Mergeable moments: what the tests need of a unit frame, one row per metric and variant.

A *state* row holds, for one metric of one variant, the number of units, their total, mean and sum of squared
deviations, the same of a second variable, and the co-moment of the two.  States of disjoint sets of units (parts of a
run, cohorts of one exposure day) merge by the pairwise update, in any order and without the units.

A family's metrics are unpivoted with one ``stack`` and summed with one ``groupBy(metric, variant)``: its plan has a few
aggregate functions whatever the number of metrics, partial sums are formed where the units are, and a handful of rows
is shuffled.

``operators.daily`` keeps states by day.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit.operators.metrics import Agg

_MEAN = re.compile(r"AVG\(CAST\((.*) AS DOUBLE\)\)", re.DOTALL)
_SD = re.compile(r"STDDEV_SAMP\(CAST\((.*) AS DOUBLE\)\)", re.DOTALL)
_COV = re.compile(r"COVAR_SAMP\(CAST\((.*) AS DOUBLE\), CAST\((.*) AS DOUBLE\)\)", re.DOTALL)
_SUM = re.compile(r"SUM\((.*)\)", re.DOTALL)
_USERS = re.compile(r"COUNT\(DISTINCT (?:CASE WHEN (.*) THEN (\w+) ELSE NULL END|(\w+))\)", re.DOTALL)


@dataclass(frozen=True)
class Metric:
    """What a published column says of the units: a statistic of ``x`` (and ``y``), or of who satisfies ``x``."""

    stat: str               # mean | sd | total | cov | users
    x: str
    y: str | None = None
    unit: str | None = None  # users: the column whose distinct values count


def metric(agg: Agg) -> Metric:
    """The metric behind a published column."""
    if m := _COV.fullmatch(agg.sql):
        return Metric("cov", m[1], m[2])
    if m := _MEAN.fullmatch(agg.sql):
        return Metric("mean", m[1])
    if m := _SD.fullmatch(agg.sql):
        return Metric("sd", m[1])
    if m := _USERS.fullmatch(agg.sql):
        return Metric("users", m[1] or "TRUE", None, m[2] or m[3])
    if m := _SUM.fullmatch(agg.sql):
        return Metric("total", m[1])
    raise ValueError(f"{agg.name} is no moment: {agg.sql}")


STATE = ["N", "TOTAL", "MEAN", "M2", "TOTAL_Y", "MEAN_Y", "M2_Y", "C"]


def state(units: DataFrame, metrics: dict[str, Metric], by: list[str] | None = None, distinct_units: bool = True) -> DataFrame:
    """(by…, METRIC, state) of the units, for metrics under the given names; ``by`` is the variant unless told otherwise.

    ``distinct_units``: each unit stands on one row of its group, so users are counted as rows.  Without it they
    are first reduced to one row a unit.
    """
    by = by or ["VARIANT_ID"]
    plain = {name: (m.x, m.y) for name, m in metrics.items() if m.stat != "users"}
    users = {name: m for name, m in metrics.items() if m.stat == "users"}
    rows = []
    if distinct_units:
        plain |= {name: (f"CASE WHEN {m.unit} IS NOT NULL AND ({m.x}) THEN 1 ELSE 0 END", None) for name, m in users.items()}
    else:
        for unit in sorted({m.unit for m in users.values()}):
            own = {name: m for name, m in users.items() if m.unit == unit}
            flags = [F.max(F.expr(f"CASE WHEN {m.x} THEN 1 ELSE 0 END")).alias(f"_f{i}") for i, m in enumerate(own.values())]
            reduced = units.where(F.col(unit).isNotNull()).groupBy(*by, unit).agg(*flags)
            rows.append(_long(reduced, {name: (f"_f{i}", None) for i, name in enumerate(own)}, by))
    if plain:
        rows.append(_long(units, plain, by))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    # Population variances and covariances times n are the sums of squared deviations.
    n = F.count("x")

    def exact(v: str) -> Column:
        return F.coalesce(F.sum(f"{v}_exact").cast("double"), F.sum(v))

    return out.groupBy(*by, "METRIC").agg(
        n.alias("N"), exact("x").alias("TOTAL"), F.try_divide(exact("x"), n).alias("MEAN"), (F.var_pop("x") * n).alias("M2"),
        exact("y").alias("TOTAL_Y"), F.try_divide(exact("y"), n).alias("MEAN_Y"), (F.var_pop("y") * n).alias("M2_Y"), (F.covar_pop("x", "y") * n).alias("C"))


def _long(units: DataFrame, variables: dict[str, tuple[str, str | None]], by: list[str]) -> DataFrame:
    """(by…, METRIC, x, x_exact, y, y_exact): each unit once for each variable or pair, by one ``stack``.

    Of a pair both are NULL where one is.  Whole and decimal numbers also come as DECIMAL, whose sums are exact.
    """
    columns: dict[str, str] = {}
    for x, y in variables.values():
        columns.setdefault(x if y is None else f"CASE WHEN ({y}) IS NOT NULL THEN {x} END", f"_v{len(columns)}")
        if y is not None:
            columns.setdefault(f"CASE WHEN ({x}) IS NOT NULL THEN {y} END", f"_v{len(columns)}")
    wide = units.select(*by, *(F.expr(v).alias(c) for v, c in columns.items()))
    floating = {f.name for f in wide.schema.fields if f.dataType.typeName() in ("double", "float")}

    def both_types(v: str | None) -> str:
        c = columns[v] if v is not None else "NULL"
        return f"CAST({c} AS DOUBLE), CAST({'NULL' if c in floating else c} AS DECIMAL(38,4))"

    def args(name: str, x: str, y: str | None) -> str:
        if y is None:
            return f"'{name}', {both_types(x)}, {both_types(None)}"
        return f"'{name}', {both_types(f'CASE WHEN ({y}) IS NOT NULL THEN {x} END')}, {both_types(f'CASE WHEN ({x}) IS NOT NULL THEN {y} END')}"

    listed = ", ".join(args(name, x, y) for name, (x, y) in variables.items())
    return wide.selectExpr(*by, f"stack({len(variables)}, {listed}) AS (METRIC, x, x_exact, y, y_exact)")


def merge(states: DataFrame, part: str, by: list[str] | None = None) -> DataFrame:
    """States of disjoint parts (told apart by the column ``part``) as one, by the pairwise update, in order of the parts.

    The number of parts is that of days or of runs, so the list that is folded is short whatever the number of units.
    """
    by = by or ["VARIANT_ID"]
    fields = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in STATE[1:]]
    each = F.struct(F.col(part).alias("part"), F.col("N").cast("double").alias("N"), *fields, F.col("C").isNotNull().alias("paired"))
    kept = ", ".join(f"{c} double" for c in STATE)
    zero = f"cast(struct({', '.join('0D' for _ in STATE)}) as struct<{kept.replace(' double', ':double')}>)"

    def moved(total: str, x: str, y: str) -> str:
        return f"a.{total} + b.{total} + if(a.N = 0D or b.N = 0D, 0D, (b.MEAN{x} - a.MEAN{x}) * (b.MEAN{y} - a.MEAN{y}) * a.N * b.N / (a.N + b.N))"

    def mean(x: str) -> str:
        return f"if(a.N + b.N = 0D, 0D, (a.TOTAL{x} + b.TOTAL{x}) / (a.N + b.N))"

    step = (f"struct(a.N + b.N, a.TOTAL + b.TOTAL, {mean('')}, {moved('M2', '', '')}, a.TOTAL_Y + b.TOTAL_Y, {mean('_Y')}, {moved('M2_Y', '_Y', '_Y')},"
            f" {moved('C', '', '_Y')})")
    folded = F.expr(f"aggregate(array_sort(parts), {zero}, (a, b) -> cast({step} as struct<{kept.replace(' double', ':double')}>))")
    merged = states.groupBy(*by, "METRIC").agg(F.collect_list(each).alias("parts"), F.bool_or(F.col("C").isNotNull()).alias("paired"))
    merged = merged.withColumn("s", folded)
    second = ("TOTAL_Y", "MEAN_Y", "M2_Y", "C")
    return merged.select(*by, "METRIC", F.col("s.N").cast("long").alias("N"), *(
        (F.when(F.col("paired"), F.col(f"s.{c}")) if c in second else F.col(f"s.{c}")).alias(c) for c in STATE[1:]))


def statistic(stat: Column) -> Column:
    """The published statistic (by its name) of a state row, rounded as published."""
    less = F.when(F.col("N") > 1, F.col("N") - 1)
    value = (F.when(stat == "mean", F.col("MEAN")).when(stat == "sd", F.sqrt(F.col("M2") / less)).when(stat == "cov", F.col("C") / less)
             .otherwise(F.col("TOTAL")))
    return F.round(value, 6)
