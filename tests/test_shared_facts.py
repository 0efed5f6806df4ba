"""Families that run together read the window's lines from one joined and written table, with the same rows."""

import datetime

import pytest

from expkit.operators import builders as B
from expkit.plans import catalog
from expkit.plans import registry as G
from expkit.sources.adapters import Domain

DAY = datetime.datetime(1997, 1, 1)


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    """Orders around both ends of the window, an order that comes twice, lines without an order and without a key."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = [DAY + datetime.timedelta(days=d, hours=h) for d, h in ((-2, 0), (-1, 23), (0, 0), (5, 7), (200, 0), (364, 23), (365, 0), (365, 23), (366, 0), (367, 1))]
    orders = [(i, 1 + i % 3, "OFP"[i % 3], 100.0 + i, t, ("1-URGENT", "2-HIGH", "3-MEDIUM")[i % 3]) for i, t in enumerate(at)]
    orders += [orders[3], (None, 1, "F", 5.0, DAY, "1-URGENT"), (50, 1, "F", 5.0, None, "1-URGENT")]
    lines = [(o[0], 1 + n, 1 + n, n + 1, 2.0, 10.0, 0.1 * (n % 2), 0.05, "NRA"[n % 3], "OF"[n % 2]) for o in orders for n in range(4)]
    lines += [(99, 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "N", "O"), lines[20]]
    ts = "timestamp_ntz"
    spark.createDataFrame(orders, f"o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate {ts}, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for t in ("customer", "part", "supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("build", [B.combined_txns, B.clips, B.redemptions, B.agp_daily, B.category_txns])
def test_kept_lines_give_the_rows_of_the_window(spark, folder, build):
    d, w = Domain(spark, folder), catalog.WINDOW
    want = rows(build(d, w))
    assert want and rows(build(d.keep_lines(w.start, w.end), w)) == want


@pytest.mark.parametrize("name", ["agp_daily", "category_txns"])
def test_kept_lines_are_not_joined_again(spark, sf_dir, name):
    w = catalog.WINDOW
    plan = getattr(B, name)(Domain(spark, sf_dir).keep_lines(w.start, w.end), w)._jdf.queryExecution().optimizedPlan()
    scans = [s for s in plan.collectLeaves().mkString("\n").split("\n") if "l_orderkey" in s or "l_suppkey" in s]
    assert scans and not any("l_shipdate" in s for s in scans) and all("o_orderdate" in s for s in scans)


def test_families_together_share_their_facts(spark, sf_dir, monkeypatch):
    kept = []
    keep = Domain.keep_lines
    monkeypatch.setattr(Domain, "keep_lines", lambda d, *a: (kept.append(a), keep(d, *a))[1])
    run = catalog.engine_run(spark, sf_dir)
    G.published(run, "summary")
    G.published(run, "output")
    assert kept == [(run.w.start, run.w.end)]
    single = catalog.engine_run(spark, sf_dir)
    G.published(single, "clips")
    assert len(kept) == 1
