"""Hypothesis tests (H01–H06) as DataFrame column arithmetic.

Input is a long "moments" frame with one row per (test, variant):

    TEST_ID, VARIANT_ID, TEST_TYPE ('mean' | 'rate' | 'ratio'), POOLED,
    N, M1, S1, M2, S2, COV

* mean  — M1 mean, S1 standard deviation, N units; Welch or pooled variance.
* rate  — M1 is a *count* of successes out of N; two-proportion z (pooled or not).
* ratio — M1/M2 ratio of means with SDs S1, S2 and covariance COV (delta method,
          Deng et al. 2018).

Every variant row is joined with its test's control row (a tiny broadcast
join) and the statistics are plain column expressions, so all tests of a run
are one small Spark plan.  The reference distribution is the standard normal;
p-values come from a double-precision rational approximation of Φ that is
also emitted as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit.config import CONTROL_VARIANT
from expkit.functions import columns as X

MOMENT_COLUMNS = ["TEST_ID", "VARIANT_ID", "TEST_TYPE", "POOLED", "N", "M1", "S1", "M2", "S2", "COV"]


def _value(p: str = "") -> Column:
    """Point estimate per variant: mean, rate in [0,1], or ratio of means."""
    t = F.col("TEST_TYPE")
    m1, m2, n = F.col(p + "M1"), F.col(p + "M2"), F.col(p + "N")
    return (F.when(t == "rate", F.try_divide(m1, n))
            .when(t == "ratio", F.try_divide(m1, m2))
            .otherwise(m1))


def _unit_var(p: str = "") -> Column:
    """Variance of the estimate times n (so se² = var/n for every type)."""
    t = F.col("TEST_TYPE")
    m1, m2, s1, s2, cov = (F.col(p + c) for c in ("M1", "M2", "S1", "S2", "COV"))
    rate = _value(p)
    ratio_var = (s1 * s1 / (m2 * m2) + m1 * m1 * s2 * s2 / F.pow(m2, 4) - 2 * m1 * F.coalesce(cov, F.lit(0.0)) / F.pow(m2, 3))
    return (F.when(t == "rate", rate * (1 - rate))
            .when(t == "ratio", ratio_var)
            .otherwise(s1 * s1))


def compare(moments: DataFrame, alpha: float, control: str = CONTROL_VARIANT, one_tailed: bool = False, student: bool = False) -> DataFrame:
    """Test every non-control variant against the control of its test.

    ``student``: two-sided p-values of means from Student's t, with Welch's and Satterthwaite's degrees of freedom (all
    units less two where pooled); rates and ratios keep the normal distribution, and so do the confidence bounds.
    """
    m = moments.select(*MOMENT_COLUMNS).withColumn("VALUE", _value()).withColumn("UVAR", _unit_var())
    ctrl = m.filter(F.col("VARIANT_ID") == control).select(
        "TEST_ID", *[F.col(c).alias("C_" + c) for c in ("N", "M1", "VALUE", "UVAR")])
    j = m.join(F.broadcast(ctrl), "TEST_ID", "inner")
    n_t, n_c = F.col("N").cast("double"), F.col("C_N").cast("double")
    t = F.col("TEST_TYPE")
    # Each step is a column of its own: as one expression, the tails of the distribution would repeat all of it many times.
    j = j.withColumns({
        "DELTA": F.col("VALUE") - F.col("C_VALUE"),
        "WELCH": F.col("UVAR") / n_t + F.col("C_UVAR") / n_c,
        "P_HAT": (F.col("M1") + F.col("C_M1")) / (n_t + n_c),
    })
    pooled_mean_var = ((n_t - 1) * F.col("UVAR") + (n_c - 1) * F.col("C_UVAR")) / (n_t + n_c - 2) * (1 / n_t + 1 / n_c)
    pooled_rate_var = F.col("P_HAT") * (1 - F.col("P_HAT")) * (1 / n_t + 1 / n_c)
    j = j.withColumn("VAR", F.when(F.col("POOLED") & (t == "rate"), pooled_rate_var)
                     .when(F.col("POOLED") & (t == "mean"), pooled_mean_var)
                     .otherwise(F.col("WELCH")))
    j = j.withColumn("SE", F.when(F.col("VAR") >= 0, F.sqrt("VAR")))
    j = j.withColumn("STAT", F.try_divide("DELTA", "SE"))
    delta, se, z = F.col("DELTA"), F.col("SE"), F.col("STAT")
    zcrit = X.normal_quantile(1 - alpha) if one_tailed else X.normal_quantile(1 - alpha / 2)
    p = (F.lit(1.0) - X.normal_cdf(z)) if one_tailed else X.two_sided_p(z)
    if student:
        if one_tailed:
            raise ValueError("Student's t is two-sided here")
        a, b = F.col("UVAR") / n_t, F.col("C_UVAR") / n_c
        j = j.withColumn("FREEDOM", F.when(F.col("POOLED"), n_t + n_c - 2).otherwise(F.try_divide(F.pow(a + b, 2), a * a / (n_t - 1) + b * b / (n_c - 1))))
        p = F.when((t == "mean") & (F.col("FREEDOM") >= 1), X.t_two_sided_p(z, F.col("FREEDOM"))).otherwise(p)
    is_ctrl = F.col("VARIANT_ID") == control
    scale = F.when(t == "rate", F.lit(100.0)).otherwise(F.lit(1.0))
    out = j.select(
        "TEST_ID", "VARIANT_ID",
        X.rnd(F.col("VALUE") * scale).alias("MEAN"),
        X.rnd(F.when(~is_ctrl, delta * scale)).alias("ABSOLUTE_DELTA"),
        X.rnd(F.when(~is_ctrl, F.try_divide(delta, F.col("C_VALUE")) * 100)).alias("RELATIVE_DELTA"),
        X.rnd(F.when(~is_ctrl, z)).alias("Z"),
        X.rnd(F.when(~is_ctrl & z.isNotNull(), p)).alias("P_VALUE"),
        X.rnd(F.when(~is_ctrl, (delta - zcrit * se) * scale)).alias("CI_LOWER"),
        X.rnd(F.when(~is_ctrl, (delta + zcrit * se) * scale)).alias("CI_UPPER"),
    )
    return out.withColumn("SIGNIFICANT", F.when(F.col("P_VALUE").isNotNull(), F.col("P_VALUE") < alpha))


# ---------------------------------------------------------------------------
# SQL twins (for the DuckDB oracle)
# ---------------------------------------------------------------------------

def _horner_sql(x: str, coefs: tuple[float, ...]) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"(({acc}) * {x} + {c!r})"
    return acc


def normal_tail_sql(z: str) -> str:
    """SQL text for Φ(−|z|) with the same rational form as the Spark expression."""
    a = f"ABS(CAST({z} AS DOUBLE))"
    e = f"EXP(-({a}) * ({a}) / 2)"
    near = f"({e}) * {_horner_sql(a, X._HART_P)} / {_horner_sql(a, X._HART_Q)}"
    b = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        b = f"({a} + {k} / {b})"
    far = f"({e}) / {b} / {X._SQRT_2PI!r}"
    return f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"


def compare_sql(moments_sql: str, alpha: float, control: str = CONTROL_VARIANT) -> str:
    zcrit = X.normal_quantile(1 - alpha / 2)
    val = ("CASE WHEN TEST_TYPE = 'rate' THEN CAST(M1 AS DOUBLE) / NULLIF(N, 0) "
           "WHEN TEST_TYPE = 'ratio' THEN M1 / NULLIF(M2, 0) ELSE M1 END")
    uvar = (f"CASE WHEN TEST_TYPE = 'rate' THEN ({val}) * (1 - ({val})) "
            "WHEN TEST_TYPE = 'ratio' THEN S1 * S1 / (M2 * M2) + M1 * M1 * S2 * S2 / POWER(M2, 4) "
            "- 2 * M1 * COALESCE(COV, 0.0) / POWER(M2, 3) ELSE S1 * S1 END")
    return f"""
WITH m AS MATERIALIZED (SELECT *, {val} AS VALUE, {uvar} AS UVAR FROM ({moments_sql}) q),
c AS MATERIALIZED (SELECT TEST_ID, N AS C_N, M1 AS C_M1, VALUE AS C_VALUE, UVAR AS C_UVAR FROM m WHERE VARIANT_ID = '{control}'),
j AS MATERIALIZED (
  SELECT m.*, c.C_N, c.C_M1, c.C_VALUE, c.C_UVAR,
         m.VALUE - c.C_VALUE AS DELTA,
         CASE WHEN POOLED AND TEST_TYPE = 'rate'
                THEN ((m.M1 + c.C_M1) / (CAST(m.N AS DOUBLE) + c.C_N)) * (1 - ((m.M1 + c.C_M1) / (CAST(m.N AS DOUBLE) + c.C_N)))
                     * (1 / CAST(m.N AS DOUBLE) + 1 / CAST(c.C_N AS DOUBLE))
              WHEN POOLED AND TEST_TYPE = 'mean'
                THEN ((CAST(m.N AS DOUBLE) - 1) * m.UVAR + (CAST(c.C_N AS DOUBLE) - 1) * c.C_UVAR)
                     / (CAST(m.N AS DOUBLE) + c.C_N - 2) * (1 / CAST(m.N AS DOUBLE) + 1 / CAST(c.C_N AS DOUBLE))
              ELSE m.UVAR / CAST(m.N AS DOUBLE) + c.C_UVAR / CAST(c.C_N AS DOUBLE) END AS VAR
  FROM m JOIN c ON m.TEST_ID = c.TEST_ID),
k AS MATERIALIZED (SELECT *, CASE WHEN VAR >= 0 THEN SQRT(VAR) END AS SE,
             DELTA / NULLIF(CASE WHEN VAR >= 0 THEN SQRT(VAR) END, 0) AS Z,
             CASE WHEN TEST_TYPE = 'rate' THEN 100.0 ELSE 1.0 END AS SCALE,
             VARIANT_ID = '{control}' AS IS_CTRL FROM j)
SELECT TEST_ID, VARIANT_ID,
  ROUND(VALUE * SCALE, 6) AS MEAN,
  ROUND(CASE WHEN NOT IS_CTRL THEN DELTA * SCALE END, 6) AS ABSOLUTE_DELTA,
  ROUND(CASE WHEN NOT IS_CTRL THEN DELTA / NULLIF(C_VALUE, 0) * 100 END, 6) AS RELATIVE_DELTA,
  ROUND(CASE WHEN NOT IS_CTRL THEN Z END, 6) AS Z,
  ROUND(CASE WHEN NOT IS_CTRL AND Z IS NOT NULL THEN LEAST(1.0, 2.0 * {normal_tail_sql('Z')}) END, 6) AS P_VALUE,
  ROUND(CASE WHEN NOT IS_CTRL THEN (DELTA - {zcrit!r} * SE) * SCALE END, 6) AS CI_LOWER,
  ROUND(CASE WHEN NOT IS_CTRL THEN (DELTA + {zcrit!r} * SE) * SCALE END, 6) AS CI_UPPER,
  CASE WHEN NOT IS_CTRL AND Z IS NOT NULL THEN ROUND(LEAST(1.0, 2.0 * {normal_tail_sql('Z')}), 6) < {alpha!r} END AS SIGNIFICANT
FROM k
"""


def chi2_sf_sql(x: str, df: str, max_df: int = 8) -> str:
    import math

    parts = []
    for k in range(1, max_df + 1):
        if k % 2 == 0:
            terms = " + ".join(f"POWER(({x}) / 2, {i}) / {float(math.factorial(i))!r}" for i in range(k // 2))
            parts.append(f"WHEN {df} = {k} THEN EXP(-({x}) / 2) * ({terms})")
        else:
            s = f"SQRT({x})"
            expr = f"2.0 * {normal_tail_sql(s)}"
            dfact = 1.0
            for i in range(1, (k - 1) // 2 + 1):
                dfact *= 2 * i - 1
                expr += f" + 2.0 * EXP(-({s}) * ({s}) / 2) / {X._SQRT_2PI!r} * POWER({x}, {i - 0.5}) / {dfact!r}"
            parts.append(f"WHEN {df} = {k} THEN {expr}")
    return f"(CASE WHEN {df} < 1 THEN NULL WHEN ({x}) <= 0 THEN 1.0 {' '.join(parts)} ELSE NULL END)"
