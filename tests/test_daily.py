"""Mergeable moments, household days and the day-wise refresh, on small frames."""

import datetime
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from expkit.config import DEMO_CONFIG
from expkit.operators import daily as Y
from expkit.operators import moments as Q
from expkit.operators.metrics import Agg
from expkit.sources import sinks

SPECS = {
    "n": Agg("N", "COUNT(DISTINCT HH)", "cnt"), "buyers": Agg("B", "COUNT(DISTINCT CASE WHEN x > 0 THEN HH ELSE NULL END)", "cnt"),
    "mean": Agg("M", "AVG(CAST(x AS DOUBLE))", "dbl"), "sd": Agg("S", "STDDEV_SAMP(CAST(CASE WHEN x > 0 THEN x ELSE NULL END AS DOUBLE))", "dbl"),
    "total": Agg("T", "SUM(x)", "dec"), "cov": Agg("C", "COVAR_SAMP(CAST(x AS DOUBLE), CAST(y AS DOUBLE))", "dbl"), "ymean": Agg("Y", "AVG(CAST(y AS DOUBLE))", "dbl"),
}


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("AB"), i % 5, round(rng.choice([0.0, rng.expovariate(0.05)]), 2), None if i % 7 == 0 else rng.gauss(3, 1)) for i in range(400)]
    rows.append((None, "A", 2, 5.0, 1.0))
    return spark.createDataFrame(rows, "HH long, VARIANT_ID string, part int, x double, y double").withColumn("x", F.col("x").cast("decimal(38,4)"))


def values(states, metrics):
    out = {}
    for name, m in metrics.items():
        for r in states.where(F.col("METRIC") == name).select("VARIANT_ID", Q.statistic(F.lit(m.stat)).alias("v")).collect():
            out[name, r.VARIANT_ID] = r.v
    return out


def test_states_equal_the_published_columns_and_merge(units):
    metrics = {k: Q.metric(a) for k, a in SPECS.items()}
    direct = values(Q.state(units, metrics), metrics)
    for v in "AB":
        own = units.where(F.col("VARIANT_ID") == v)
        for k, a in SPECS.items():
            assert direct[k, v] == pytest.approx(float(own.agg(F.expr(a.sql)).first()[0]), abs=2e-6)
    parts = Q.state(units, metrics, by=["VARIANT_ID", "part"])
    assert values(Q.merge(parts, "part"), metrics) == pytest.approx(direct, abs=2e-6)
    # Merging what is merged already, and a part of one unit, change nothing.
    halves = Q.merge(parts.where("part < 2"), "part").withColumn("part", F.lit(0)).unionByName(Q.merge(parts.where("part >= 2"), "part").withColumn("part", F.lit(1)))
    assert values(Q.merge(halves, "part"), metrics) == pytest.approx(direct, abs=2e-6)


def test_users_count_once_where_they_stand_on_several_rows(units):
    metrics = {k: Q.metric(SPECS[k]) for k in ("n", "buyers")}
    twice = units.unionAll(units.where("HH % 2 = 0").withColumn("x", F.lit(0).cast("decimal(38,4)")))
    assert values(Q.state(twice, metrics, distinct_units=False), metrics) == values(Q.state(units, metrics), metrics)


def test_what_is_no_moment_is_refused():
    with pytest.raises(ValueError):
        Q.metric(Agg("X", "MAX(x)", "dec"))


@pytest.fixture(scope="module")
def shop(spark):
    """Exposures and transactions by hand, with a household that holds a third of all rows."""
    rng = random.Random(2)
    day = lambda n: datetime.date(1997, 1, 1) + datetime.timedelta(days=n)
    E = [(h, rng.choice(["VARIANT A", "VARIANT B"]), day(rng.randint(0, 60))) for h in range(40)] + [(90, None, day(3))]
    txns = [(h, h * 1000 + i, day(rng.randint(-5, 130)), rng.choice(["ECOMM", "STORE"]), round(rng.uniform(1, 50), 2), float(rng.randint(1, 9)), 0.0)
            for h in range(45) for i in range(rng.randint(0, 6))]
    txns += [(7, 700000 + i, day(rng.randint(0, 130)), "STORE", 1.25, 1.0, 0.5) for i in range(60)]
    txns += [(8, 8000, day(4), "ECOMM", 2.0, 1.0, 0.0), (8, 8000, day(4), "STORE", 3.0, 1.0, 0.0), (None, 1, day(4), "STORE", 9.0, 1.0, 0.0)]
    schema = "HOUSEHOLD_ID long, TXN_ID long, TXN_DTE date, TXN_LOCATION string, REVENUE double, ITEMS double, SNAP_TENDER double"
    frame = spark.createDataFrame(txns, schema)
    for c in ("REVENUE", "ITEMS", "SNAP_TENDER"):
        frame = frame.withColumn(c, F.col(c).cast("decimal(38,4)"))
    return spark.createDataFrame(E, "HOUSEHOLD_ID long, VARIANT_ID string, EXPOSURE_DATETIME date"), frame, E, txns


def totals(txns, h, since, until):
    own = [t for t in txns if t[0] == h and since <= t[2] <= until]
    return (len({t[1] for t in own}), round(sum(t[4] for t in own), 4), round(sum(t[5] for t in own), 4), round(sum(t[6] for t in own), 4))


def test_looked_up_totals_equal_the_facts_since_exposure(shop):
    E, frame, exposures, txns = shop
    end = datetime.date.fromisoformat(DEMO_CONFIG.end)
    sums = Y.suffix_sums(Y.household_days(frame, DEMO_CONFIG))
    got = {r.HOUSEHOLD_ID: (r.NUM_ORDERS, float(r.TOT_REVENUE), float(r.NUM_UNITS), float(r.TOT_SNAP)) for r in Y.since_exposure(E, sums, DEMO_CONFIG).collect()}
    assert got == {h: pytest.approx(totals(txns, h, since, end)) for h, v, since in exposures if v}
    late = Y.since_exposure(E.withColumn("EXPOSURE_DATETIME", F.lit("1997-12-30").cast("date")), sums, DEMO_CONFIG).agg(F.sum("NUM_ORDERS")).first()[0]
    assert late == 0


def test_every_day_has_the_moments_of_the_units_so_far(shop):
    E, frame, exposures, txns = shop
    active = Y.unit_days(E, Y.household_days(frame, DEMO_CONFIG), DEMO_CONFIG)
    states = Y.daily_states(Y.changes(Y.entries(E, Y.TXN_MEASURES), Y.running_units(active)), Y.TXN_METRICS)
    rows = Y.txn_report(Y.as_of(states)).collect()
    assert len(rows) > 40
    for r in rows:
        held = [totals(txns, h, since, r.DAY) for h, v, since in exposures if v == r.VARIANT_ID and since <= r.DAY]
        money = [t[1] for t in held]
        assert r.VISITORS == len(held) and r.REVENUE_MEAN == pytest.approx(statistics.mean(money), abs=1e-6)
        assert r.CVR == pytest.approx(sum(t[0] > 0 for t in held) / len(held), abs=1e-6)
        if len(held) > 1:
            assert r.REVENUE_SD == pytest.approx(statistics.stdev(money), abs=1e-5)
            assert r.COV_REVENUE_ORDERS == pytest.approx(statistics.covariance(money, [t[0] for t in held]), abs=1e-5)


def test_a_refresh_replaces_its_days_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda n: datetime.date(1997, 3, n)
    make = lambda rows: spark.createDataFrame(rows, "k int, DAY date")
    read = lambda: sorted((r.k, r.DAY.day) for r in sinks.read_days(spark, path, "DAY").collect())
    with pytest.raises(FileNotFoundError):
        sinks.read_days(spark, path, "DAY")
    sinks.refresh_days(make([(1, day(1)), (2, day(2)), (3, day(3))]), path, "DAY", "1997-03-01", "1997-03-03")
    before = sinks.read_days(spark, path, "DAY")
    for _ in range(2):
        sinks.refresh_days(make([(20, day(2))]), path, "DAY", "1997-03-02", "1997-03-02")
        assert read() == [(1, 1), (3, 3), (20, 2)]
    assert before.count() == 3  # a reader that began earlier still has its files
    sinks.refresh_days(make([]), path, "DAY", "1997-03-03", "1997-03-04")  # a day can become empty
    assert read() == [(1, 1), (20, 2)]
    with pytest.raises(ValueError):
        sinks.refresh_days(make([(5, day(9))]), path, "DAY", "1997-03-04", "1997-03-05")
    with pytest.raises(ValueError):
        sinks.refresh_days(make([(5, None)]), path, "DAY", "1997-03-04", "1997-03-05")
    assert read() == [(1, 1), (20, 2)]
    sinks.refresh_days(make([(7, day(1))]), path, "DAY", "1997-03-01", "1997-03-31")  # a whole rebuild: what it replaces goes
    sinks.refresh_days(make([(8, day(31))]), path, "DAY", "1997-03-31", "1997-03-31")
    assert read() == [(7, 1), (8, 31)]
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2


def test_a_refresh_that_dies_before_publishing_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, datetime.date(1997, 3, 1))], "k int, DAY date")
    sinks.refresh_days(rows, path, "DAY", "1997-03-01", "1997-03-01")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_create", dies)
        with pytest.raises(RuntimeError):
            sinks.refresh_days(rows.withColumn("k", F.lit(9)), path, "DAY", "1997-03-01", "1997-03-01")
    assert [r.k for r in sinks.read_days(spark, path, "DAY").collect()] == [1]
    # Two writers of one number: the second is refused.
    number, published = sinks._published(spark, path)
    with pytest.raises(RuntimeError):
        sinks._create(spark, f"{path}/_published/{number:08d}.json", "[]")
    assert sinks._published(spark, path) == (number, published)


def test_a_refresh_builds_its_rows_once_and_leaves_nothing_refused(spark, tmp_path):
    path, built = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            built.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, datetime.date(1997, 3, 1)), (2, datetime.date(1997, 3, 2))], "k int, DAY date").mapInArrow(seen, "k int, DAY date")
    sinks.refresh_days(rows, path, "DAY", "1997-03-01", "1997-03-02")
    assert built.value == 2
    with pytest.raises(ValueError):
        sinks.refresh_days(rows, path, "DAY", "1997-03-02", "1997-03-03")
    assert sinks.read_days(spark, path, "DAY").count() == 2
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1


def test_the_refreshed_table_reads_its_lines_once(spark, sf_dir, monkeypatch):
    from expkit.plans import catalog

    stored = []
    keep = sinks.store

    def noted(df):
        stored.append(keep(df))
        return stored[-1]

    plans = []
    refresh = sinks.refresh_days
    monkeypatch.setattr(sinks, "store", noted)
    monkeypatch.setattr(sinks, "refresh_days", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), refresh(df, *a))[1])
    catalog.QUERIES["combined_daily_refreshed"](spark, sf_dir)
    assert len(stored) == 1 and set(stored[0].columns) >= {"UNIT", "VARIANT_ID", "DAY", "NUM_ORDERS"}
    assert plans and not any("l_orderkey" in p for p in plans)
