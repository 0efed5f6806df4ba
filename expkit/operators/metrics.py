"""Metric aggregation (M01–M24): exposure ⟕ facts → unit grain → variant grain.

Unit frames
-----------
Every family attaches facts to the exposure frame ``E`` (one row per unit)
with an equi-join on the unit key plus a date bound (``exposure <= fact date``),
then zero-fills units without facts.  The join is written skew-safe:

    facts ⋈ E (inner; the large, possibly skewed fact side streams, and AQE can
      split a hot partition of it) → partial aggregation per unit (a household
      with a third of all facts is reduced map-side before the shuffle)
      → E ⟕ per-unit result (1:1 on the unit key) → zero-fill.

Variant aggregates
------------------
Each family's per-variant outputs are listed once as ``Agg(name, sql, kind)``
rows.  The SQL expressions use only functions Spark and DuckDB share (SUM,
AVG, STDDEV_SAMP, COVAR_SAMP, COUNT(DISTINCT), CASE, NULLIF); Spark evaluates
them with ``F.expr`` (JVM-side, codegen) and the DuckDB oracle inlines the same
text, so the registry is the single definition of every published column.
Variants are few, so these aggregations end in a handful of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expkit import config as C
from expkit.config import ExperimentConfig

# ---------------------------------------------------------------------------
# Aggregate specification shared with the oracle
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Agg:
    name: str
    sql: str
    kind: str  # 'cnt' → BIGINT, 'dec' → DECIMAL(38,4), 'dbl' → DOUBLE rounded to 6 places

    def wrapped(self) -> str:
        sql = exact_means(self.sql)
        if self.kind == "cnt":
            return f"CAST({sql} AS BIGINT)"
        if self.kind == "dec":
            return f"CAST({sql} AS DECIMAL(38,4))"
        return f"ROUND(CAST({sql} AS DOUBLE), 6)"

    def col(self) -> Column:
        return F.expr(self.wrapped()).alias(self.name)

    def select_sql(self) -> str:
        return f"{self.wrapped()} AS {self.name}"


def exact_means(sql: str) -> str:
    """Rewrite ``AVG(CAST(x AS DOUBLE))`` as ``CAST(SUM(x) AS DOUBLE) / COUNT(x)``.

    On DECIMAL and integer inputs the sum is exact, so the mean no longer depends on the order in which
    partial sums meet (a double AVG does, by a few ulps — enough to flip a rounded digit between runs).
    """
    key = "AVG(CAST("
    out, i = [], 0
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k = j + len(key)
        depth, m = 1, k
        while depth:
            if sql[m] == "(":
                depth += 1
            elif sql[m] == ")":
                depth -= 1
            m += 1
        inner = sql[k:m - 1]                    # "x AS DOUBLE"
        assert inner.endswith(" AS DOUBLE"), inner
        x = exact_means(inner[: -len(" AS DOUBLE")])
        assert sql[m] == ")"
        out.append(sql[i:j] + f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))")
        i = m + 1


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _nz(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN NULL ELSE {x} END"


def _pos(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE NULL END"


def _div(a: str, b: str) -> str:
    return f"{_dbl(a)} / NULLIF({_dbl(b)}, 0)"


def _win(x: str, thr: str, on: bool) -> str:
    return f"CASE WHEN {thr} > 0 AND {x} > {thr} THEN {thr} ELSE {x} END" if on else x


def tms(prefix: str, x: str, total_kind: str = "dec", nonzero: bool = False, nz_label: str = "NONZERO") -> list[Agg]:
    out = [Agg(f"{prefix}_TOTAL", f"SUM({x})", total_kind),
           Agg(f"{prefix}_MEAN", f"AVG({_dbl(x)})", "dbl"),
           Agg(f"{prefix}_SD", f"STDDEV_SAMP({_dbl(x)})", "dbl")]
    if nonzero:
        out += [Agg(f"{prefix}_{nz_label}_MEAN", f"AVG({_dbl(_nz(x))})", "dbl"),
                Agg(f"{prefix}_{nz_label}_SD", f"STDDEV_SAMP({_dbl(_nz(x))})", "dbl")]
    return out


def aggregate(units: DataFrame, specs: list[Agg], by: str = "VARIANT_ID") -> DataFrame:
    return units.groupBy(by).agg(*[s.col() for s in specs])


def aggregate_sql(source: str, specs: list[Agg], by: str = "VARIANT_ID") -> str:
    cols = ",\n  ".join(s.select_sql() for s in specs)
    return f"SELECT {by},\n  {cols}\nFROM {source}\nGROUP BY {by}"


# ---------------------------------------------------------------------------
# Unit-frame helper
# ---------------------------------------------------------------------------

def _d(s: str) -> Column:
    return F.lit(s).cast("date")


def _agg_names(aggs: list[Column]) -> list[str]:
    """Output names of aliased aggregate columns."""
    out = []
    for a in aggs:
        name = a._jc.toString()
        out.append(name.rsplit(" AS ", 1)[-1].strip("`"))
    return out


def attach(E: DataFrame, facts: DataFrame, e_key: str, f_key: str, aggs: list[Column],
           defaults: dict[str, Column], cond=None) -> DataFrame:
    """Attach per-unit aggregates of ``facts`` to every row of ``E`` (zero-filled).

    ``cond(m)`` may reference exposure columns as ``_E_<name>``.
    """
    ecols = E.columns
    ek = [f"_E_{c}" for c in ecols]
    Ek = E.filter(F.col(e_key).isNotNull()).select(*[F.col(c).alias(f"_E_{c}") for c in ecols])
    m = facts.join(Ek, facts[f_key] == Ek[f"_E_{e_key}"], "inner")
    if cond is not None:
        m = m.filter(cond(m))
    # Group by a struct of the exposure key, not the key columns: the join's hash partitioning on the
    # household does not satisfy it, so the aggregation gets its own exchange with map-side partial
    # aggregation — and AQE may split a hot household's join partition (it declines when a split would
    # need an extra shuffle, which is the case when the aggregation reuses the join's partitioning).
    m = m.select(F.struct(*ek).alias("_xk_unit"), *[c for c in m.columns if c not in ek])
    per = m.groupBy("_xk_unit").agg(*aggs).select("_xk_unit.*", *[a for a in _agg_names(aggs)])
    j = E.join(per, [E[c].eqNullSafe(per[f"_E_{c}"]) for c in ecols], "left")
    return j.select(*[E[c] for c in ecols], *[F.coalesce(F.col(n), v).alias(n) for n, v in defaults.items()])


def attach_levels(E: DataFrame, facts: DataFrame, e_key: str, f_key: str, levels: list[tuple[list[str], list[Column]]],
                  defaults: dict[str, Column], cond=None) -> DataFrame:
    """Like ``attach`` but aggregating in several levels: ``levels`` lists (keys besides the unit, aggregates),
    finest first; the last is per unit and has no keys.

    Used where one fact pass must serve several counts: a fine level collapses each unit's facts to one row
    per transaction (or offer × transaction) with flags and sums, the next ones turn the flags into exact
    distinct counts, so the facts are never expanded once per distinct count.
    """
    ecols = E.columns
    ek = [f"_E_{c}" for c in ecols]
    Ek = E.filter(F.col(e_key).isNotNull()).select(*[F.col(c).alias(f"_E_{c}") for c in ecols])
    m = facts.join(Ek, facts[f_key] == Ek[f"_E_{e_key}"], "inner")
    if cond is not None:
        m = m.filter(cond(m))
    per = m.select(F.struct(*ek).alias("_xk_unit"), *[c for c in m.columns if c not in ek])
    for keys, aggs in levels:
        per = per.groupBy("_xk_unit", *keys).agg(*aggs)
    per = per.select("_xk_unit.*", *_agg_names(levels[-1][1]))
    j = E.join(per, [E[c].eqNullSafe(per[f"_E_{c}"]) for c in ecols], "left")
    return j.select(*[E[c] for c in ecols], *[F.coalesce(F.col(n), v).alias(n) for n, v in defaults.items()])


LOCATIONS = ("ECOMM", "STORE")


def _zero_l() -> Column:
    return F.lit(0).cast("bigint")


def _zero_d() -> Column:
    return F.lit(0).cast("decimal(38,4)")


def _zero_f() -> Column:
    return F.lit(0.0)


def metric_exposure(E: DataFrame) -> DataFrame:
    """Units with a variant (rows without a variant are dropped in every family)."""
    return E.filter(F.col("VARIANT_ID").isNotNull())


# ---------------------------------------------------------------------------
# M01–M03 engagement
# ---------------------------------------------------------------------------

def engagement_units(E: DataFrame, visit_order: DataFrame, cart_coupon: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Visits, orders, revenue, units, cart adds, clips and searches per exposed unit.

    Web units without a household are matched on the device id (``ID``),
    units with a household on ``HOUSEHOLD_ID``; the two halves are unioned.
    """
    E = metric_exposure(E)
    sd = F.to_date("VISIT_START_TS")
    ed = F.to_date("VISIT_END_TS")
    vo = visit_order.filter((sd.between(_d(cfg.start), _d(cfg.end))) | (ed.between(_d(cfg.start), _d(cfg.end))))
    ev = (cart_coupon.filter(F.to_date("DTE").between(_d(cfg.start), _d(cfg.end)) & F.col("EVENT_TYPE").isNotNull()))

    def half(Eh: DataFrame, key: str) -> DataFrame:
        # Visits (per visit) and hits (per unit × hit time × type) become one stream of fact rows with a
        # common time column, so a single join + aggregation attaches both (the original chains three joins).
        v = (vo.groupBy("VISIT_ID", key, "VISIT_START_TS", "VISIT_END_TS")
             .agg(F.sum("NUM_ORDERS").cast("bigint").alias("_o"), F.sum("TOT_REVENUE").cast("decimal(38,4)").alias("_r"),
                  F.sum("NUM_UNITS").cast("bigint").alias("_u"))
             .select(F.col(key).cast("string").alias("_fk"), F.col("VISIT_END_TS").cast("timestamp").alias("_ts"),
                     "VISIT_ID", "_o", "_r", "_u", *[F.lit(0).cast("bigint").alias(c) for c in ("_ca", "_cc", "_se")]))
        h = (ev.groupBy(F.col(key).cast("string").alias("_fk"), F.col("DTE").cast("timestamp").alias("_ts"))
             .agg(F.sum((F.col("EVENT_TYPE") == "CART_ADD").cast("bigint")).alias("_ca"),
                  F.sum((F.col("EVENT_TYPE") == "COUPON_CLIP").cast("bigint")).alias("_cc"),
                  F.sum((F.col("EVENT_TYPE") == "SEARCH").cast("bigint")).alias("_se"))
             .select("_fk", "_ts", F.lit(None).cast("string").alias("VISIT_ID"), F.lit(None).cast("bigint").alias("_o"),
                     F.lit(None).cast("decimal(38,4)").alias("_r"), F.lit(None).cast("bigint").alias("_u"),
                     "_ca", "_cc", "_se"))
        Eh = Eh.withColumn("_ek", F.col(key).cast("string"))
        b = attach(Eh, v.unionByName(h), "_ek", "_fk",
                   [F.count_distinct("VISIT_ID").alias("NUM_VISITS"), F.sum("_o").alias("NUM_ORDERS"),
                    F.sum("_r").alias("TOT_REVENUE"), F.sum("_u").alias("NUM_UNITS"),
                    F.sum("_ca").alias("NUM_CART_ADDS"), F.sum("_cc").alias("COUPON_CLIPS"), F.sum("_se").alias("NUM_SEARCHES")],
                   {"NUM_VISITS": _zero_l(), "NUM_ORDERS": _zero_l(), "TOT_REVENUE": _zero_d(), "NUM_UNITS": _zero_l(),
                    "NUM_CART_ADDS": _zero_l(), "COUPON_CLIPS": _zero_l(), "NUM_SEARCHES": _zero_l()},
                   cond=lambda m: m["_ts"] >= m["_E_EXPOSURE_DATETIME"].cast("timestamp"))
        return b.drop("_ek")

    hh = half(E.filter(F.col("HOUSEHOLD_ID").isNotNull()), "HOUSEHOLD_ID")
    if cfg.platform != "Adobe":
        return hh
    av = half(E.filter(F.col("HOUSEHOLD_ID").isNull()), "ID")
    # Units with and without a household are different rows, each once.
    return av.unionByName(hh)


def engagement_specs(cfg: ExperimentConfig) -> list[Agg]:
    U = cfg.unit_col
    cd = f"COUNT(DISTINCT {U})"

    def users(x: str) -> str:
        return f"COUNT(DISTINCT CASE WHEN {x} > 0 THEN {U} ELSE NULL END)"

    s = [Agg("VISITORS", cd, "cnt"), Agg("UNIQUE_HOUSEHOLDS", "COUNT(DISTINCT HOUSEHOLD_ID)", "cnt")]
    s += tms("VISITS", "NUM_VISITS", "cnt")
    s += tms("ORDERS", "NUM_ORDERS", "cnt", nonzero=True)
    s += [Agg("UNIQUE_USERS_THAT_ORDER", users("NUM_ORDERS"), "cnt"),
          Agg("CVR", _div(users("NUM_ORDERS"), cd), "dbl")]
    s += tms("UNITS", "NUM_UNITS", "cnt", nonzero=True)
    s += tms("REVENUE", "TOT_REVENUE", "dec", nonzero=True)
    s += tms("COUPON_CLIPS", "COUPON_CLIPS", "cnt", nonzero=True)
    s += [Agg("UNIQUE_USERS_THAT_COUPON_CLIP", users("COUPON_CLIPS"), "cnt"),
          Agg("COUPON_CLIP_CVR", _div(users("COUPON_CLIPS"), cd), "dbl")]
    s += tms("CART_ADDS", "NUM_CART_ADDS", "cnt", nonzero=True, nz_label="CONDITIONAL")
    s += [Agg("UNIQUE_USERS_THAT_ADDTOCART", users("NUM_CART_ADDS"), "cnt"),
          Agg("CART_ADDS_CVR", _div(users("NUM_CART_ADDS"), cd), "dbl")]
    s += tms("SEARCHES", "NUM_SEARCHES", "cnt", nonzero=True, nz_label="CONDITIONAL")
    s += [Agg("UNIQUE_USERS_THAT_SEARCH", users("NUM_SEARCHES"), "cnt"),
          Agg("SEARCHES_CVR", _div(users("NUM_SEARCHES"), cd), "dbl")]
    s += [Agg("AOV", _div(f"AVG({_dbl(_pos('TOT_REVENUE'))})", f"AVG({_dbl(_pos('NUM_ORDERS'))})"), "dbl"),
          Agg("COV_REVENUE_ORDERS", f"COVAR_SAMP({_dbl('TOT_REVENUE')}, {_dbl('NUM_ORDERS')})", "dbl"),
          Agg("UPO", _div(f"AVG({_dbl(_pos('NUM_UNITS'))})", f"AVG({_dbl(_pos('NUM_ORDERS'))})"), "dbl"),
          Agg("COV_UNITS_ORDERS", f"COVAR_SAMP({_dbl('NUM_UNITS')}, {_dbl('NUM_ORDERS')})", "dbl"),
          Agg("RPV", _div("SUM(TOT_REVENUE)", cd), "dbl")]
    return s


# ---------------------------------------------------------------------------
# M04 margin, M05 AGP (+ M07/M08 winsorization)
# ---------------------------------------------------------------------------

def margin_units(E: DataFrame, margin: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Weekly margin from the Sunday week of exposure to the end date, per household unit."""
    from expkit.functions.columns import sunday_week_start

    E = metric_exposure(E).filter(F.col("HOUSEHOLD_ID").isNotNull())
    E = E.withColumn("EXP_WEEK_START", sunday_week_start("EXPOSURE_DATETIME"))
    m = margin.filter(F.col("FISCAL_WEEK_START_DT") <= _d(cfg.end))
    return attach(E, m, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
                  [F.sum("AGP_VAL_WITHOUT_INSTA_ADJ").alias("margin")], {"margin": _zero_d()},
                  cond=lambda x: x["FISCAL_WEEK_START_DT"] >= x["_E_EXP_WEEK_START"])


def margin_specs(cfg: ExperimentConfig) -> list[Agg]:
    return [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt")] + tms("MARGIN", "margin", "dec", nonzero=True)


def stored_units(units: DataFrame) -> DataFrame:
    """A unit frame cut off in the shared checkpoint folder."""
    from expkit.sources.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(units.sparkSession)
    return units.checkpoint(eager=True)


def winsor_threshold(units: DataFrame, cols: dict[str, str], cfg: ExperimentConfig) -> DataFrame:
    """One-row frame of 99th percentiles over units with a household, all variants pooled.

    ``percentile_approx`` is a mergeable sketch (partial aggregation); its rank
    error is bounded by n / accuracy, so the published threshold scales to any n.
    With ``cfg.exact_percentile`` the thresholds are exact, by counting refinement.
    """
    base = units.filter(F.col("HOUSEHOLD_ID").isNotNull())
    if cfg.exact_percentile:
        from expkit.operators.quantile import exact_quantiles

        exact = exact_quantiles(base, cols, cfg.winsor_quantile)
        return base.sparkSession.range(1).select(*[F.lit(v).cast(base.schema[cols[n]].dataType).alias(n) for n, v in exact.items()])
    return base.agg(*[F.percentile_approx(src, cfg.winsor_quantile, cfg.percentile_accuracy).alias(name)
                      for name, src in cols.items()])


def with_threshold(units: DataFrame, thr_cols: dict[str, str], cfg: ExperimentConfig) -> DataFrame:
    """Attach winsor thresholds of ``units`` as scalar subqueries (computed once, inlined as values; no join).

    The unit frame (one row per unit, small next to the facts) is first written to the shared checkpoint
    folder, so the percentile subquery and the main aggregation read one result instead of joining the
    facts twice, and a lost executor costs no more than its own tasks.
    """
    units = stored_units(units)
    thr = winsor_threshold(units, thr_cols, cfg)
    for c in thr.columns:
        units = units.withColumn(c, thr.select(c).scalar())
    return units


def agp_units(E: DataFrame, agp: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    E = metric_exposure(E)
    a = agp.filter(F.col("TXN_DTE") <= _d(cfg.end))
    u = attach(E, a, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
               [F.sum("NET_SALES").alias("TOT_NET_SALES"), F.sum("AGP_TOT").alias("AGP")],
               {"TOT_NET_SALES": _zero_d(), "AGP": _zero_f()},
               cond=lambda x: x["TXN_DTE"] >= x["_E_EXPOSURE_DATETIME"])
    return with_threshold(u, {"_WIN_NS": "TOT_NET_SALES"}, cfg)


def agp_specs(cfg: ExperimentConfig) -> list[Agg]:
    ns = _win("TOT_NET_SALES", "_WIN_NS", cfg.winsorize)
    return ([Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt")]
            + tms("NET_SALES", ns, "dec") + tms("AGP", "AGP", "dbl"))


# ---------------------------------------------------------------------------
# M06, M09–M14 transactions and redemptions by location
# ---------------------------------------------------------------------------

def txn_location_units(E: DataFrame, combined_txns: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Per-unit transaction metrics for every location and overall, from ONE join of the facts.

    Columns ``<L>_NUM_ORDERS, <L>_TOT_REVENUE, <L>_NUM_UNITS, <L>_TOT_SNAP, <L>_TOT_NET_SALES, <L>_ROWS`` for
    L in ECOMM, STORE, ALL.  Orders are distinct transactions per location (a flag per unit × transaction).
    """
    E = metric_exposure(E)
    t = combined_txns.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)))
    loc = F.col("TXN_LOCATION")
    meas = {"TOT_REVENUE": "REVENUE", "NUM_UNITS": "ITEMS", "TOT_SNAP": "SNAP_TENDER", "TOT_NET_SALES": "NET_SALES"}
    inner, outer, dflt = [], [], {}
    for L in LOCATIONS + ("ALL",):
        cond = F.lit(True) if L == "ALL" else (loc == L)
        inner.append(F.max(cond.cast("int")).alias(f"_has_{L}"))
        inner.append(F.sum(cond.cast("bigint")).alias(f"_rows_{L}"))
        inner += [F.sum(F.when(cond, F.col(src))).alias(f"_{name}_{L}") for name, src in meas.items()]
        outer.append(F.sum(f"_has_{L}").cast("bigint").alias(f"{L}_NUM_ORDERS"))
        outer.append(F.sum(f"_rows_{L}").cast("bigint").alias(f"{L}_ROWS"))
        outer += [F.sum(f"_{name}_{L}").alias(f"{L}_{name}") for name in meas]
        dflt[f"{L}_NUM_ORDERS"] = _zero_l()
        dflt[f"{L}_ROWS"] = _zero_l()
        dflt.update({f"{L}_{name}": _zero_d() for name in meas})
    return attach_levels(E, t, "HOUSEHOLD_ID", "HOUSEHOLD_ID", [(["TXN_ID"], inner), ([], outer)], dflt,
                         cond=lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"])


def txn_units(E: DataFrame, combined_txns: DataFrame, cfg: ExperimentConfig, location: str | None,
              bnc: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Orders, revenue, units, SNAP (and for e-commerce net sales and first-purchase count) per unit.

    ``shared`` is ``txn_location_units`` of the same run: the e-commerce, in-store and combined families
    then read one join of the transaction facts instead of three.
    """
    E = metric_exposure(E)
    u = shared if shared is not None else txn_location_units(E, combined_txns, cfg)
    L = location or "ALL"
    ecomm = location == "ECOMM"
    cols = [F.col(f"{L}_NUM_ORDERS").alias("NUM_ORDERS"), F.col(f"{L}_TOT_REVENUE").alias("TOT_REVENUE"),
            F.col(f"{L}_NUM_UNITS").alias("NUM_UNITS"), F.col(f"{L}_TOT_SNAP").alias("TOT_SNAP")]
    if ecomm:
        cols += [F.col(f"{L}_TOT_NET_SALES").alias("TOT_NET_SALES"), F.col(f"{L}_ROWS").alias("_rows")]
    u = u.select(*E.columns, *cols)
    thr_cols = {"_WIN_REV": "TOT_REVENUE"}
    if ecomm:
        # The original counts first-purchase rows across the joined transaction rows (one row when there are none).
        b = (bnc.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)))
             .groupBy("HOUSEHOLD_ID").agg(F.count(F.lit(1)).alias("_bnc")))
        u = u.join(b, "HOUSEHOLD_ID", "left")
        u = (u.withColumn("ECOMM_BNC_COUNT",
                          (F.coalesce("_bnc", _zero_l()) * F.greatest(F.col("_rows"), F.lit(1))).cast("bigint"))
             .drop("_bnc", "_rows"))
        thr_cols["_WIN_NS"] = "TOT_NET_SALES"
    return with_threshold(u, thr_cols, cfg)


def txn_specs(cfg: ExperimentConfig, prefix: str, ecomm: bool = False) -> list[Agg]:
    U, P = cfg.unit_col, prefix
    rev = _win("TOT_REVENUE", "_WIN_REV", cfg.winsorize)
    hh = "COUNT(DISTINCT HOUSEHOLD_ID)"
    s = [Agg("VISITORS", f"COUNT(DISTINCT {U})", "cnt"),
         Agg("PURCHASING_CUSTOMERS", "COUNT(DISTINCT CASE WHEN NUM_ORDERS > 0 THEN HOUSEHOLD_ID ELSE NULL END)", "cnt"),
         Agg("WINSORIZED_CUSTOMERS",
             "COUNT(DISTINCT CASE WHEN _WIN_REV > 0 AND TOT_REVENUE > _WIN_REV THEN HOUSEHOLD_ID ELSE NULL END)"
             if cfg.winsorize else "0", "cnt"),
         Agg("WINSORIZATION_THRESHOLD", "MAX(_WIN_REV)", "dec")]
    s += tms(f"{P}_ORDERS", "NUM_ORDERS", "cnt")
    s += tms(f"{P}_UNITS", "NUM_UNITS", "dec")
    s += [Agg(f"{P}_REVENUE_TOTAL", f"SUM({rev})", "dec"),
          Agg(f"{P}_REVENUE_MEAN", f"AVG({_dbl(rev)})", "dbl"),
          Agg(f"{P}_RPV", _div(f"SUM({rev})", hh), "dbl"),
          Agg(f"{P}_NONZERO_RPV", _div(f"SUM(CASE WHEN TOT_REVENUE = 0 THEN NULL ELSE {rev} END)", hh), "dbl"),
          Agg(f"{P}_REVENUE_SD", f"STDDEV_SAMP({_dbl(rev)})", "dbl"),
          Agg(f"{P}_REVENUE_NONZERO_MEAN", f"AVG({_dbl(f'CASE WHEN TOT_REVENUE = 0 THEN NULL ELSE {rev} END')})", "dbl"),
          Agg(f"{P}_REVENUE_NONZERO_SD", f"STDDEV_SAMP({_dbl(f'CASE WHEN TOT_REVENUE = 0 THEN NULL ELSE {rev} END')})", "dbl")]
    s += tms(f"{P}_SNAP", "TOT_SNAP", "dec")
    if ecomm:
        ns = _win("TOT_NET_SALES", "_WIN_NS", cfg.winsorize)
        nzns = f"CASE WHEN TOT_NET_SALES = 0 THEN NULL ELSE {ns} END"
        s += [Agg("ECOMM_BNC_TOTAL", "SUM(ECOMM_BNC_COUNT)", "cnt"),
              Agg("ECOMM_BNC_TOTAL_SD", f"STDDEV_SAMP({_dbl(_nz('ECOMM_BNC_COUNT'))})", "dbl"),
              Agg("ECOMM_NET_SALES_TOTAL", f"SUM({ns})", "dec"),
              Agg("ECOMM_NET_SALES_MEAN", f"AVG({_dbl(ns)})", "dbl"),
              Agg("ECOMM_NET_SALES_RPV", _div(f"SUM({ns})", hh), "dbl"),
              Agg("ECOMM_NET_SALES_NONZERO_RPV", _div(f"SUM({nzns})", hh), "dbl"),
              Agg("ECOMM_NET_SALES_SD", f"STDDEV_SAMP({_dbl(ns)})", "dbl"),
              Agg("ECOMM_NET_SALES_NONZERO_MEAN", f"AVG({_dbl(nzns)})", "dbl"),
              Agg("ECOMM_NET_SALES_NONZERO_SD", f"STDDEV_SAMP({_dbl(nzns)})", "dbl")]
    s += [Agg(f"{P}_AOV", _div(f"AVG({_dbl(f'CASE WHEN TOT_REVENUE > 0 THEN {rev} ELSE NULL END')})",
                               f"AVG({_dbl(_pos('NUM_ORDERS'))})"), "dbl"),
          Agg(f"{P}_COV_REVENUE_ORDERS", f"COVAR_SAMP({_dbl(rev)}, {_dbl('NUM_ORDERS')})", "dbl"),
          Agg(f"{P}_UPO", _div(f"AVG({_dbl(_pos('NUM_UNITS'))})", f"AVG({_dbl(_pos('NUM_ORDERS'))})"), "dbl"),
          Agg(f"{P}_COV_UNITS_ORDERS", f"COVAR_SAMP({_dbl('NUM_UNITS')}, {_dbl('NUM_ORDERS')})", "dbl")]
    return s


def redemption_location_units(E: DataFrame, combined_txns: DataFrame, redemptions: DataFrame,
                               cfg: ExperimentConfig) -> DataFrame:
    """M09/M10 for every location at once: ``<L>_<type>_MKDN``, ``<L>_total_mkdn``, ``<L>_<type>_redemptions``
    and ``<L>_total_redemptions`` for L in ECOMM, STORE, ALL, from one transaction ⟕ redemption join.

    Transactions meet redemptions on the transaction id, with the window predicate in the join condition
    (out-of-window transactions carry no offer, exactly as the original's left join leaves them).  Redemption counts are distinct (offer, transaction)
    pairs per unit: a first aggregation per unit × offer × transaction (× type) carries location flags,
    the second sums them — no COUNT(DISTINCT) expansion of the fact rows.
    """
    E = metric_exposure(E)
    t = combined_txns
    in_win = t["TXN_DTE"].between(_d(cfg.start), _d(cfg.end))
    r = redemptions.select(F.col("TXN_ID").alias("_r_txn"), "CLIENT_OFFER_ID", "OFFER_TYPE_MOD", "MKDN")
    # Inner join: transactions without a redemption add nothing to any redemption metric (units are
    # zero-filled afterwards), and an inner join lets AQE split a hot transaction id on either side.
    tr = t.join(r, (t["TXN_ID"] == r["_r_txn"]) & in_win, "inner").select(
        "HOUSEHOLD_ID", "TXN_ID", "TXN_DTE", "TXN_LOCATION", "CLIENT_OFFER_ID", "OFFER_TYPE_MOD", "MKDN")
    cond = lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"]
    loc, typ = F.col("TXN_LOCATION"), F.col("OFFER_TYPE_MOD")
    places = {L: (F.lit(True) if L == "ALL" else (loc == L)) for L in LOCATIONS + ("ALL",)}
    types = {ty: ty.lower() for ty in C.OFFER_TYPES}
    # Per unit × offer × transaction × type, then × offer × transaction, then per unit.
    by_type, by_pair, by_unit, zero = [], [], [], {}
    known = F.col("CLIENT_OFFER_ID").isNotNull()
    for L, here in places.items():
        by_type += [F.max(here.cast("int")).alias(f"_has_{L}"), F.sum(F.when(here, F.col("MKDN")).otherwise(0)).alias(f"_mkdn_{L}")]
        by_pair += [F.max(f"_has_{L}").alias(f"_any_{L}"), F.sum(f"_mkdn_{L}").alias(f"_all_{L}")]
        for ty, name in types.items():
            by_pair += [F.max(F.when(typ == ty, F.col(f"_has_{L}"))).alias(f"_has_{L}_{name}"),
                        F.sum(F.when(typ == ty, F.col(f"_mkdn_{L}"))).alias(f"_mkdn_{L}_{name}")]
            by_unit += [F.sum(f"_mkdn_{L}_{name}").alias(f"{L}_{name}_MKDN"),
                        F.sum(F.when(known, F.col(f"_has_{L}_{name}"))).cast("bigint").alias(f"{L}_{name}_redemptions")]
            zero |= {f"{L}_{name}_MKDN": _zero_d(), f"{L}_{name}_redemptions": _zero_l()}
        by_unit += [F.sum(f"_all_{L}").alias(f"{L}_total_mkdn"), F.sum(F.when(known, F.col(f"_any_{L}"))).cast("bigint").alias(f"{L}_total_redemptions")]
        zero |= {f"{L}_total_mkdn": _zero_d(), f"{L}_total_redemptions": _zero_l()}
    pair = ["CLIENT_OFFER_ID", "TXN_ID"]
    return attach_levels(E, tr, "HOUSEHOLD_ID", "HOUSEHOLD_ID", [([*pair, "OFFER_TYPE_MOD"], by_type), (pair, by_pair), ([], by_unit)], zero, cond=cond)


def redemption_units(E: DataFrame, combined_txns: DataFrame, redemptions: DataFrame, cfg: ExperimentConfig,
                     location: str | None, shared: DataFrame | None = None) -> DataFrame:
    """Redemption metrics of one location (or all) per unit, read from the shared per-location frame."""
    E = metric_exposure(E)
    u = shared if shared is not None else redemption_location_units(E, combined_txns, redemptions, cfg)
    L = location or "ALL"
    names = [f"{ty.lower()}_MKDN" for ty in C.OFFER_TYPES] + ["total_mkdn"]
    names += [f"{ty.lower()}_redemptions" for ty in C.OFFER_TYPES] + ["total_redemptions"]
    return u.select(*E.columns, *[F.col(f"{L}_{n}").alias(n) for n in names])


def redemption_specs(cfg: ExperimentConfig, loc: str | None) -> list[Agg]:
    U = cfg.unit_col
    hh = "COUNT(DISTINCT HOUSEHOLD_ID)"
    if loc == "ECOMM":
        red_cnt, rpo_m, rpo_s, pre = "REDEEMING_COUNT_ECOMM", "RPO_ECOMM_MEAN", "RPO_EECOMM_SD", "ECOMM_"
    elif loc == "STORE":
        red_cnt, rpo_m, rpo_s, pre = "REDEEMING_COUNT_STORE", "RPO_STORE_MEAN", "RPO_ESTORE_SD", "STORE_"
    else:
        red_cnt, rpo_m, rpo_s, pre = "REDEEMING_COUNT_COMBINED", "RPO_COMBINED_MEAN", "RPO_ECOMBINED_SD", ""
    s = [] if loc else [Agg("VISITORS", f"COUNT(DISTINCT {U})", "cnt")]
    s += [Agg(red_cnt, "COUNT(DISTINCT CASE WHEN total_redemptions > 0 THEN HOUSEHOLD_ID ELSE NULL END)", "cnt"),
          Agg(rpo_m, f"AVG({_dbl(_pos('total_redemptions'))})", "dbl"),
          Agg(rpo_s, f"STDDEV_SAMP({_dbl(_pos('total_redemptions'))})", "dbl"),
          Agg(f"{pre}REDEMPTIONS_TOTAL", "SUM(total_redemptions)", "cnt"),
          Agg(f"{pre}REDEMPTIONS_AVG_REAL", _div("SUM(total_redemptions)", hh), "dbl"),
          Agg(f"{pre}REDEMPTIONS_MEAN", f"AVG({_dbl('total_redemptions')})", "dbl"),
          Agg(f"{pre}REDEMPTIONS_SD", f"STDDEV_SAMP({_dbl('total_redemptions')})", "dbl"),
          Agg(f"{pre}MKDN_TOTAL", "SUM(total_mkdn)", "dec"),
          Agg(f"{pre}MKDN_AVG_REAL", _div("SUM(total_mkdn)", hh), "dbl"),
          Agg(f"{pre}MKDN_MEAN", f"AVG({_dbl('total_mkdn')})", "dbl"),
          Agg(f"{pre}MKDN_SD", f"STDDEV_SAMP({_dbl('total_mkdn')})", "dbl")]
    for stat, fn in (("TOTAL", "SUM({x})"), ("MEAN", "AVG(CAST({x} AS DOUBLE))"), ("SD", "STDDEV_SAMP(CAST({x} AS DOUBLE))")):
        for ty in C.OFFER_TYPES:
            x = f"{ty.lower()}_redemptions"
            s.append(Agg(f"{x}_{stat}", fn.format(x=x), "cnt" if stat == "TOTAL" else "dbl"))
    for stat, fn in (("TOTAL", "SUM({x})"), ("MEAN", "AVG(CAST({x} AS DOUBLE))"), ("SD", "STDDEV_SAMP(CAST({x} AS DOUBLE))")):
        for ty in C.OFFER_TYPES:
            x = f"{ty.lower()}_MKDN"
            s.append(Agg(f"{x}_{stat}", fn.format(x=x), "dec" if stat == "TOTAL" else "dbl"))
    return s


def location_variant(E: DataFrame, combined_txns: DataFrame, redemptions: DataFrame, cfg: ExperimentConfig,
                     location: str, bnc: DataFrame | None = None, txn_shared: DataFrame | None = None,
                     red_shared: DataFrame | None = None) -> DataFrame:
    """Transaction aggregate joined with the redemption aggregate of one location."""
    tu = txn_units(E, combined_txns, cfg, location, bnc, shared=txn_shared)
    ru = redemption_units(E, combined_txns, redemptions, cfg, location, shared=red_shared)
    ta = aggregate(tu, txn_specs(cfg, location, ecomm=location == "ECOMM"))
    ra = aggregate(ru, redemption_specs(cfg, location))
    return ta.join(ra, "VARIANT_ID")



# ---------------------------------------------------------------------------
# M15/M16 bonus points, M17 clips, M18 basket health, M19 gas, M20 category, M21 account health
# ---------------------------------------------------------------------------

def bonus_points_daily(points_header: DataFrame, points: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Bonus points per household and day (base offers, superseded and deleted rows excluded)."""
    t = points_header.filter(F.to_date("TRANSACTION_TS").between(_d(cfg.start), _d(cfg.end)))
    p = points.filter(~F.col("OFFER_ID").isin(*C.BASE_POINT_OFFERS) & F.col("DW_CURRENT_VERSION_IND")
                      & ~F.col("DW_LOGICAL_DELETE_IND"))
    return (t.join(p, "TRANSACTION_INTEGRATION_ID")
            .groupBy(F.col("HOUSEHOLD_ID").try_cast("bigint").alias("HOUSEHOLD_ID"), F.to_date("TRANSACTION_TS").alias("TXN_DTE"))
            .agg(F.sum("POINTS_EARNED_NBR").alias("BONUS_POINTS_EARNED")))


def bonus_units(E: DataFrame, bp_daily: DataFrame) -> DataFrame:
    E = metric_exposure(E)
    u = attach(E, bp_daily, "HOUSEHOLD_ID", "HOUSEHOLD_ID", [F.sum("BONUS_POINTS_EARNED").alias("BONUS_POINTS")],
               {"BONUS_POINTS": _zero_l()}, cond=lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"])
    return u.withColumn("ESTIMATED_MKDN", (F.col("BONUS_POINTS") * F.lit(C.BONUS_POINTS_TO_DOLLARS)).cast("decimal(38,4)"))


def bonus_specs(cfg: ExperimentConfig) -> list[Agg]:
    return (tms("BONUS_POINTS", "BONUS_POINTS", "cnt") + tms("ESTIMATED_MKDN", "ESTIMATED_MKDN", "dec")
            + [Agg("BP_EARNING_HOUSEHOLDS", "COUNT(DISTINCT CASE WHEN BONUS_POINTS > 0 THEN HOUSEHOLD_ID ELSE NULL END)", "cnt")])


def clip_units(E: DataFrame, clips: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Distinct (offer, clip time) per unit by offer type, exposure ≤ clip ≤ end (midnight)."""
    E = metric_exposure(E)
    c = clips.filter(F.col("CLIP_TS") <= _d(cfg.end).cast("timestamp"))
    c = c.select("HOUSEHOLD_ID", "CLIENT_OFFER_ID", "CLIP_TS", "OFFER_TYPE_MOD")
    cond = lambda x: x["_E_EXPOSURE_DATETIME"].cast("timestamp") <= x["CLIP_TS"]
    types = {ty: f"{ty.lower()}_clips" for ty in C.OFFER_TYPES}
    per_clip = [F.max((F.col("OFFER_TYPE_MOD") == ty).cast("int")).alias(f"_{n}") for ty, n in types.items()]
    per_unit = [F.sum(f"_{n}").cast("bigint").alias(n) for n in types.values()] + [F.count(F.lit(1)).alias("total_clips")]
    return attach_levels(E, c, "HOUSEHOLD_ID", "HOUSEHOLD_ID", [(["CLIENT_OFFER_ID", "CLIP_TS"], per_clip), ([], per_unit)],
                         {n: _zero_l() for n in [*types.values(), "total_clips"]}, cond=cond)


def clip_specs(cfg: ExperimentConfig) -> list[Agg]:
    s = [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt"),
         Agg("UNIQUE_CLIPPING_HH", "COUNT(DISTINCT CASE WHEN total_clips > 0 THEN HOUSEHOLD_ID ELSE NULL END)", "cnt")]
    s += tms("CLIPS", "total_clips", "cnt", nonzero=True)
    s += [Agg("CLIPS_AVG_REAL", _div("SUM(total_clips)", "COUNT(DISTINCT HOUSEHOLD_ID)"), "dbl")]
    for ty in C.OFFER_TYPES:
        s += tms(f"{ty.lower()}_clips", f"{ty.lower()}_clips", "cnt")
    return s


def basket_units(E: DataFrame, basket_health: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Shares of a unit's graded transactions per grade; net = (A+B) − (D+E)."""
    E = metric_exposure(E)
    bh = basket_health.filter(F.col("TXN_DTE") <= _d(cfg.end))
    g = F.col("OVERALL_CATEGORY")
    a, b, c, d, e = C.BASKET_GRADES
    graded = {"_g_a": g == a, "_g_b": g == b, "_g_c": g == c, "_g_d": g == d, "_g_e": g == e, "_g_ab": g.isin(a, b), "_g_de": g.isin(d, e)}
    # One row per unit and transaction with flags; their sums are the distinct transactions per grade.
    per_txn = [F.max(cond.cast("int")).alias(f"_in{n}") for n, cond in graded.items()]
    per_unit = [F.sum(f"_in{n}").cast("bigint").alias(n) for n in graded] + [F.count("TXN_ID").alias("TOTAL_TXNS")]
    u = attach_levels(E, bh, "HOUSEHOLD_ID", "HOUSEHOLD_ID", [(["TXN_ID"], per_txn), ([], per_unit)],
                      {n: _zero_l() for n in [*graded, "TOTAL_TXNS"]}, cond=lambda x: x["TXN_DTE"] >= x["_E_EXPOSURE_DATETIME"])

    def rate(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("TOTAL_TXNS").cast("double")), F.lit(0.0))

    return u.select(*E.columns, rate("_g_a").alias("Perfect_rate"), rate("_g_b").alias("great_rate"),
                    rate("_g_c").alias("acceptable_rate"), rate("_g_d").alias("needs_improvement_rate"),
                    rate("_g_e").alias("poor_rate"), (rate("_g_ab") - rate("_g_de")).alias("Net_Basket_rate"),
                    rate("_g_ab").alias("AB_RATE"), rate("_g_de").alias("DE_RATE"), "TOTAL_TXNS")


def basket_specs(cfg: ExperimentConfig) -> list[Agg]:
    s = [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt"),
         Agg("UNIQUE_BASKET_HEALTH_HH", "COUNT(DISTINCT HOUSEHOLD_ID)", "cnt")]
    s += tms("BASKET_RATE", "Net_Basket_rate", "dbl") + tms("AB_RATE", "AB_RATE", "dbl") + tms("DE_RATE", "DE_RATE", "dbl")
    s += [Agg("TOTAL_BASKET_HEALTH_TXNS", "SUM(TOTAL_TXNS)", "cnt")]
    return s


def gas_units(E: DataFrame, gas: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    E = metric_exposure(E)
    g = gas.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)))
    u = attach(E, g, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
               [F.count_distinct("TXN_ID").alias("NUM_ORDERS"), F.sum("REVENUE").alias("TOT_REVENUE"),
                F.sum("GAS_REWARD_REDEMPTIONS").alias("GAS_REWARD_REDEMPTIONS"), F.sum("GAS_MKDN").alias("_gm")],
               {"NUM_ORDERS": _zero_l(), "TOT_REVENUE": _zero_d(), "GAS_REWARD_REDEMPTIONS": _zero_d(), "_gm": _zero_d()},
               cond=lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"])
    return u.withColumn("GAS_MKDN", (-F.col("_gm")).cast("decimal(38,4)")).drop("_gm")


def gas_specs(cfg: ExperimentConfig) -> list[Agg]:
    hh = "COUNT(DISTINCT HOUSEHOLD_ID)"
    s = [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt"),
         Agg("GAS_VISITORS", "COUNT(DISTINCT CASE WHEN NUM_ORDERS > 0 THEN HOUSEHOLD_ID ELSE NULL END)", "cnt")]
    s += tms("GAS_ORDERS", "NUM_ORDERS", "cnt")
    s += tms("GAS_REVENUE", "TOT_REVENUE", "dec", nonzero=True)
    s += tms("GAS_REWARD_REDEMPTIONS", "GAS_REWARD_REDEMPTIONS", "dec")
    s += tms("GAS_MKDN", "GAS_MKDN", "dec")
    s += [Agg("GAS_AOV", _div(f"AVG({_dbl(_pos('TOT_REVENUE'))})", f"AVG({_dbl(_pos('NUM_ORDERS'))})"), "dbl"),
          Agg("GAS_COV_REVENUE_ORDERS", f"COVAR_SAMP({_dbl('TOT_REVENUE')}, {_dbl('NUM_ORDERS')})", "dbl"),
          Agg("GAS_RPV", _div("SUM(TOT_REVENUE)", hh), "dbl"),
          Agg("GAS_NONZERO_RPV", _div(f"SUM({_nz('TOT_REVENUE')})", hh), "dbl"),
          Agg("GAS_REDEMPTIONS_PER_VISITOR", _div("SUM(GAS_REWARD_REDEMPTIONS)", hh), "dbl")]
    return s


def category_units(E: DataFrame, category: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Category breadth and items; bounded by the run window only (not by the exposure date)."""
    E = metric_exposure(E)
    c = category.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)))
    return attach(E, c, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
                  [F.count_distinct("SMIC_CATEGORY_ID").alias("NUM_CATEGORIES"), F.sum("ITEM_QTY").alias("ITEMS")],
                  {"NUM_CATEGORIES": _zero_l(), "ITEMS": _zero_d()})


def category_specs(cfg: ExperimentConfig) -> list[Agg]:
    s = [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt"),
         Agg("UNIQUE_HOUSEHOLDS", "COUNT(DISTINCT HOUSEHOLD_ID)", "cnt")]
    s += tms("CATEGORIES", "NUM_CATEGORIES", "cnt") + tms("ITEMS", "ITEMS", "dec")
    s += [Agg("CATEGORY_DEPTH", _div(f"AVG({_dbl(_pos('ITEMS'))})", f"AVG({_dbl(_pos('NUM_CATEGORIES'))})"), "dbl"),
          Agg("CD_COV_ITEMS_CATEGORIES", f"COVAR_SAMP({_dbl('ITEMS')}, {_dbl('NUM_CATEGORIES')})", "dbl")]
    return s


def account_units(E: DataFrame, account_health: DataFrame) -> DataFrame:
    E = metric_exposure(E)
    ah = account_health.select(F.col("household_id").try_cast("bigint").alias("_ah_hh"),
                               "email_ind", "phone_ind", "fn_ln_ind", "bday_ind", "address_ind")
    j = E.join(ah, E["HOUSEHOLD_ID"] == ah["_ah_hh"], "left")
    return j.drop("_ah_hh")


def account_specs(cfg: ExperimentConfig) -> list[Agg]:
    score = "email_ind + phone_ind + fn_ln_ind + bday_ind + address_ind"
    return [Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt"),
            Agg("UNIQUE_HOUSEHOLDS", "COUNT(DISTINCT HOUSEHOLD_ID)", "cnt"),
            Agg("email_count", "SUM(email_ind)", "cnt"),
            Agg("phone_count", "SUM(phone_ind)", "cnt"),
            Agg("reachablity_score", "SUM(CASE WHEN email_ind > 0 AND phone_ind > 0 THEN 1 ELSE 0 END)", "cnt"),
            Agg("fn_ln_count", "SUM(fn_ln_ind)", "cnt"),
            Agg("bday_count", "SUM(bday_ind)", "cnt"),
            Agg("address_count", "SUM(address_ind)", "cnt"),
            Agg("health_score", f"AVG({_dbl(score)})", "dbl"),
            Agg("stdev_health_score", f"STDDEV_SAMP({_dbl(score)})", "dbl")]


# ---------------------------------------------------------------------------
# M22 markdown strategies (combined) and V05 comparison inputs
# ---------------------------------------------------------------------------

def markdown_units(E: DataFrame, combined_txns_md: DataFrame, cfg: ExperimentConfig,
                   location: str | None = None) -> DataFrame:
    """The three markdown strategies per unit, from transaction grain (all locations, or one)."""
    E = metric_exposure(E)
    t = combined_txns_md.filter(F.col("TXN_DTE").between(_d(cfg.start), _d(cfg.end)))
    if location:
        t = t.filter(F.col("TXN_LOCATION") == location)
    u = attach(E, t, "HOUSEHOLD_ID", "HOUSEHOLD_ID",
                  [F.sum("TOTAL_MARKDOWN").alias("TOTAL_MARKDOWN"), F.sum("MKDN_AMT").alias("MKDN_AMT"),
                   F.sum("COMBINED_MKDN").alias("COMBINED_MKDN"), F.sum("NET_SALES").alias("TOT_NET_SALES"),
                   F.sum("REVENUE").alias("TOT_REVENUE")],
                  {"TOTAL_MARKDOWN": _zero_d(), "MKDN_AMT": _zero_d(), "COMBINED_MKDN": _zero_d(), "TOT_NET_SALES": _zero_d(),
                   "TOT_REVENUE": _zero_d()},
                  cond=lambda x: x["_E_EXPOSURE_DATETIME"] <= x["TXN_DTE"])
    return with_threshold(u, {"_WIN_REV": "TOT_REVENUE", "_WIN_NS": "TOT_NET_SALES"}, cfg)


def markdown_specs(cfg: ExperimentConfig, prefix: str = "") -> list[Agg]:
    """Combined names by default; ``prefix='ECOMM_'`` / ``'STORE_'`` for the location variants."""
    p = prefix
    loc = p.rstrip("_") or "COMBINED"
    return ([Agg("VISITORS", f"COUNT(DISTINCT {cfg.unit_col})", "cnt")] + tms(f"{p}TOTAL_MARKDOWN", "TOTAL_MARKDOWN")
            + tms(f"{p}MKDN_AMT", "MKDN_AMT") + tms(f"{p}COMBINED_MKDN", "COMBINED_MKDN")
            + tms(f"{loc}_NET_SALES", _win("TOT_NET_SALES", "_WIN_NS", cfg.winsorize))
            + tms(f"{loc}_REVENUE", _win("TOT_REVENUE", "_WIN_REV", cfg.winsorize)))
