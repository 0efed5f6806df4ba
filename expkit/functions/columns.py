"""Column-expression helpers.

Everything here returns a ``pyspark.sql.Column`` built from Spark's own
functions, so the expressions stay JVM-side inside whole-stage codegen.
No Python UDF is used anywhere in the library.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Casting and key normalisation
# ---------------------------------------------------------------------------

def try_int(c: ColumnOrName) -> Column:
    """``SAFE_CAST(x AS INT64)``: bad values become NULL instead of raising (ANSI mode)."""
    return F.try_cast(col(c), "bigint") if hasattr(F, "try_cast") else col(c).try_cast("bigint")


def num_key(c: ColumnOrName) -> Column:
    """Wide numeric join key: ``'000123'`` and ``123`` meet; non-numeric values become NULL (no match)."""
    return col(c).cast("string").try_cast("decimal(38,0)")


def keyed(df, column: str):
    """Rows whose ``column`` is a usable numeric key.

    Applied before an aggregation or join on the key: rows without one (guest or unreadable cards, a large
    share in retail) match nothing, and would all meet in one partition.
    """
    return df.filter(num_key(column).isNotNull())


def money(c: ColumnOrName) -> Column:
    return col(c).cast("decimal(38,4)")


def safe_div(n: ColumnOrName, d: ColumnOrName) -> Column:
    """Division that yields NULL on a zero denominator (ANSI Spark raises)."""
    return F.try_divide(col(n).cast("double"), col(d).cast("double"))


def nonzero(c: ColumnOrName) -> Column:
    """``CASE WHEN x = 0 THEN NULL ELSE x END``."""
    return F.when(col(c) != 0, col(c))


def positive(c: ColumnOrName) -> Column:
    """``IFF(x > 0, x, NULL)``."""
    return F.when(col(c) > 0, col(c))


def rnd(c: ColumnOrName, digits: int = 6) -> Column:
    """Round a floating statistic for stable comparison across engines."""
    return F.round(col(c).cast("double"), digits)


# ---------------------------------------------------------------------------
# Dates
# ---------------------------------------------------------------------------

def sunday_week_start(d: ColumnOrName) -> Column:
    """Sunday that starts the week of ``d`` (Spark truncates weeks to Monday, so shift by one day)."""
    return F.date_sub(F.date_trunc("week", F.date_add(col(d).cast("date"), 1)).cast("date"), 1)


def in_window(d: ColumnOrName, start: str, end: str, inclusive_end: bool = False) -> Column:
    c = col(d).cast("date")
    lo = c >= F.lit(start).cast("date")
    hi = (c <= F.lit(end).cast("date")) if inclusive_end else (c < F.lit(end).cast("date"))
    return lo & hi


# ---------------------------------------------------------------------------
# Delimited lists and patterns
# ---------------------------------------------------------------------------

def event_in_list(event_list: ColumnOrName, code: str) -> Column:
    """Exact membership of ``code`` in a comma-separated list (``'112'`` does not match ``'12'``)."""
    return F.array_contains(F.split(F.coalesce(col(event_list), F.lit("")), ","), F.lit(code))


def like_any(c: ColumnOrName, patterns: list[str]) -> Column:
    """OR of SQL LIKE patterns; an empty list is false."""
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [col(c).like(p) for p in patterns])


def page_patterns(page_filter: tuple[str, ...] | list[str]) -> list[str]:
    """Page-filter entries → ``%entry%`` patterns with blanks as single-character wildcards."""
    return [f"%{p.strip().lower()}%".replace(" ", "_") for p in page_filter if p.strip()]


# ---------------------------------------------------------------------------
# Winsorization
# ---------------------------------------------------------------------------

def winsorize(x: ColumnOrName, threshold: ColumnOrName, enabled: bool = True) -> Column:
    """Cap ``x`` at ``threshold`` when the threshold is positive; identity when disabled."""
    if not enabled:
        return col(x)
    t = col(threshold)
    return F.when((t > 0) & (col(x) > t), t).otherwise(col(x))


# ---------------------------------------------------------------------------
# Normal and chi-square tails as column expressions
# ---------------------------------------------------------------------------

# Coefficients of the double-precision rational approximation of
# the standard normal CDF (Hart 1968, as given by West 2005, "Better
# approximations to cumulative normal functions").
_HART_P = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_Q = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_SQRT_2PI = 2.506628274631


def _horner(x: Column, coefs: tuple[float, ...]) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_lower_tail_abs(z: ColumnOrName) -> Column:
    """``Φ(-|z|)``, accurate to double precision (no cancellation for large |z|)."""
    a = F.abs(col(z).cast("double"))
    e = F.exp(-a * a / 2)
    near = e * _horner(a, _HART_P) / _horner(a, _HART_Q)
    b = a + F.lit(0.65)
    b = a + F.lit(4.0) / b
    b = a + F.lit(3.0) / b
    b = a + F.lit(2.0) / b
    b = a + F.lit(1.0) / b
    far = e / b / F.lit(_SQRT_2PI)
    return F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)


def normal_cdf(z: ColumnOrName) -> Column:
    t = normal_lower_tail_abs(z)
    return F.when(col(z) > 0, F.lit(1.0) - t).otherwise(t)


def normal_pdf(x: ColumnOrName) -> Column:
    return F.exp(-col(x) * col(x) / 2) / F.lit(_SQRT_2PI)


def two_sided_p(z: ColumnOrName) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * normal_lower_tail_abs(z))


def chi2_sf(x: ColumnOrName, df: ColumnOrName) -> Column:
    """Chi-square survival function for any integer ``df`` by its closed finite sums, terms taken in logarithms.

    even df: exp(-x/2) Σ_{i<df/2} (x/2)^i / i!
    odd df:  2Q(√x) + 2φ(√x) Σ_{i=1}^{(df-1)/2} x^{i-1/2} / (1·3·…·(2i-1))
    """
    xv, dfc = col(x).cast("double"), col(df).cast("int")
    state = "struct<last:double,sum:double>"

    def total(count: Column, first: Column, step) -> Column:
        """Σ of ``count`` terms: exp(first), then each ``step(i)`` more in logarithm."""
        start = F.struct(first.alias("last"), F.exp(first).alias("sum")).cast(state)

        def add(acc, i):
            last = acc["last"] + step(i.cast("double"))
            return F.struct(last.alias("last"), (acc["sum"] + F.exp(last)).alias("sum")).cast(state)

        rest = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(count > 0, F.aggregate(rest, start, add, lambda acc: acc["sum"])).otherwise(F.lit(0.0))

    even = total(F.floor(dfc / 2).cast("int"), -xv / 2, lambda i: F.log(xv / 2) - F.log(i))
    odd = F.lit(2.0) * normal_lower_tail_abs(F.sqrt(xv)) + total(
        F.floor((dfc - 1) / 2).cast("int"), F.lit(math.log(2.0 / _SQRT_2PI)) - xv / 2 + F.log(xv) / 2, lambda i: F.log(xv) - F.log(2 * i + 1))
    return F.when(dfc < 1, F.lit(None).cast("double")).when(xv <= 0, F.lit(1.0)).when(dfc % 2 == 0, even).otherwise(odd)


# Lanczos' approximation of the gamma function with g = 7 (nine terms).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: ColumnOrName) -> Column:
    """ln Γ(x) for x ≥ 1/2."""
    v = col(x).cast("double") - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (v + i)
    t = v + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (v + 0.5) * F.log(t) - t + F.log(total)


def incomplete_beta(x: ColumnOrName, a: ColumnOrName, b: ColumnOrName, steps: int = 400) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 ≤ x ≤ 1 and a, b ≥ 1/2, by its continued fraction.

    The fraction converges in some √(max(a, b)) steps on the side of x below the mean; the other side follows from
    I_x(a, b) = 1 - I_{1-x}(b, a).
    """
    xv, av, bv = (col(v).cast("double") for v in (x, a, b))
    state = "struct<c:double,d:double,h:double>"

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def fraction(y: Column, p: Column, r: Column) -> Column:
        d0 = 1 / away(1 - (p + r) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h")).cast(state)

        def turn(s: Column, term: Column) -> Column:
            d, c = 1 / away(1 + term * s["d"]), away(1 + term / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h")).cast(state)

        def step(s: Column, i: Column) -> Column:
            # Terms in turn: for i = 2m the even one of m, for i = 2m + 1 the odd one.
            m = F.floor(i / 2).cast("double")
            even = m * (r - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + r + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return turn(s, F.when(i % 2 == 0, even).otherwise(odd))

        return F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), start, step, lambda s: s["h"])

    def lower(y: Column, p: Column, r: Column) -> Column:
        front = log_gamma(p + r) - log_gamma(p) - log_gamma(r) + p * F.log(y) + r * F.log(1 - y)
        return F.exp(front) * fraction(y, p, r) / p

    below = xv < (av + 1) / (av + bv + 2)
    return (F.when(xv <= 0, F.lit(0.0)).when(xv >= 1, F.lit(1.0)).when(below, lower(xv, av, bv)).otherwise(1 - lower(1 - xv, bv, av)))


def t_two_sided_p(t: ColumnOrName, df: ColumnOrName) -> Column:
    """P(|T| ≥ |t|) for Student's t with ``df`` ≥ 1 degrees of freedom (whole or not)."""
    tv, n = col(t).cast("double"), col(df).cast("double")
    return F.when(tv == 0, F.lit(1.0)).otherwise(incomplete_beta(n / (n + tv * tv), n / 2, F.lit(0.5)))


def normal_quantile(p: float) -> float:
    """Driver-side inverse normal (for the CI multiplier, a scalar of the config; Acklam's algorithm
    refined by one Halley step against ``math.erfc``)."""
    if not 0 < p < 1:
        raise ValueError("p must be in (0, 1)")
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    plow = 0.02425
    if p < plow:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= 1 - plow:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)
