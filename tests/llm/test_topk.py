import math

import numpy as np
import pytest

from expkit.llm import op1_topk as topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, dims int, row_block int"


def by_hand(rows, k, every):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
              if v and all(x is not None and math.isfinite(x) for x in v) and i is not None]
    out = []
    for q, v in usable:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("least", [2048, 16])
def test_top_k_is_exact(spark, monkeypatch, least):
    monkeypatch.setattr(topk, "LEAST_ROWS", least)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4 if least < 100 else 4096)
    monkeypatch.setattr(topk, "MOST_ROWS", least)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=37).tolist()) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 320)]  # ties
    rows += [(400, None), (401, []), (402, [float("nan")] * 37), (403, [None] + [1.0] * 36), (404, [float("inf")] * 37), (450, [0.0] * 37), (405, [1.0, 2.0]), (None, [1.0] * 37)]
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA)
    got = topk.top_k(df, every=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_hand(rows, 5, 10)


def test_fewer_rows_than_k_and_large_components(spark):
    rows = [(0, [1e6, 2e6]), (1, [3e6, -1.0]), (2, [1e6, 1e6])]
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA)
    got = topk.top_k(df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_hand(rows, 5, 50)


def test_pruning_drops_candidates_but_no_results():
    rng = np.random.default_rng(7)
    rows = np.floor(256 * rng.normal(size=(500, 64)) * np.linspace(3, 0.05, 64))
    at, row, score = topk.search_block(rows[:20], np.arange(20), rows, np.arange(500), 5)
    for j in range(20):
        full = rows @ rows[j]
        full[j] = -np.inf
        order = np.lexsort((np.arange(500), -full))[:5]
        assert row[at == j].tolist() == order.tolist() and score[at == j].tolist() == full[order].tolist()


def test_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_full_block_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(size=(topk.MOST_ROWS, 24)))
    queries = rows[:700]
    tracemalloc.start()
    at, row, score = topk.search_block(queries, np.arange(700), rows, np.arange(len(rows)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All first scores at once would be 367 MB.
    assert peak < 120 << 20
    for j in (0, 63, 64, 65, 699):  # on both sides of a tile's border
        full = rows @ rows[j]
        full[j] = -np.inf
        order = np.lexsort((np.arange(len(rows)), -full))[:5]
        assert row[at == j].tolist() == order.tolist() and score[at == j].tolist() == full[order].tolist()


def test_blocks_of_long_vectors_hold_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST_COMPONENTS", 40 * 37)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=37).tolist()) for i in range(250)]
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], SCHEMA)
    got = topk.top_k(df, every=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_hand(rows, 5, 5)
