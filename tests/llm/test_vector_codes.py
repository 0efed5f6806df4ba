import hashlib
import math

import numpy as np
import pytest

from expkit.llm import op12_vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, codes int, part long, sums string, VEC_ID_ string, copy int"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, "y", "z", 3) for i, v, label in rows], SCHEMA).repartition(partitions)


def by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd in Python integers: every part against every entry in every round."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = sorted(((i, tuple(j for _, j in a), tuple(d for d, _ in a)) for (i, _, _), a in zip(kept, assign(), strict=True)), key=repr)
    return out, books


def found(rows):
    return sorted(((r.vec_id, tuple(r.codes), tuple(r.errors)) for r in rows.collect()), key=repr)


def mixed(dims=8, n=150, spread=0.05):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, dims))
    rows = [(int(i), (middles[rng.integers(9)] + spread * rng.normal(size=dims)).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]
    rows += [(1000 + i, rows[4][1], None) for i in range(60)]  # a group of copies, label null
    rows += [rows[0], rows[0], (5, [0.0] * dims, 1), (None, rows[3][1], 2)]
    return rows + [(2000, None, 1), (2001, [None] + [0.5] * (dims - 1), 1), (2002, [float("nan")] * dims, 1), (2003, [float("-inf")] * dims, 1)]


@pytest.mark.parametrize(("entries", "rounds", "spread"), [(16, 4, 0.05), (256, 4, 0.4), (7, 0, 0.4), (3, 9, 1.0)])
def test_equals_plain_lloyd(spark, monkeypatch, entries, rounds, spread):
    monkeypatch.setattr(codes, "SLICE", 40)
    rows = mixed(spread=spread)
    coded, books = codes.compress(table(spark, rows), entries=entries, rounds=rounds, carry=("label",))
    want, want_books = by_hand(rows, entries=entries, rounds=rounds)
    assert found(coded) == want and books == want_books
    assert coded.where("carried.label is null").count() == 60


def test_equal_entries_take_the_lower_index_and_unused_ones_stay(spark):
    # Ids 0 and 1 hold the same vector, so entry 1 is never used; halves between two entries go to the lower one.
    rows = [(0, [1.0] * 4, 0), (1, [1.0] * 4, 0), (2, [3.0] * 4, 0), (3, [2.0] * 4, 0), (4, [2.0] * 4, 0), (5, [9.0, -9.0, 0.0, 2.0], 0)]
    coded, books = codes.compress(table(spark, rows), entries=3)
    want, want_books = by_hand(rows, entries=3)
    assert found(coded) == want and books == want_books and books[0][1] == [1024]


def test_active_entries_give_what_a_full_search_gives():
    rng = np.random.default_rng(11)
    x = rng.integers(-4, 5, size=(3000, 3))  # coarse, so ties are frequent
    entries = rng.integers(-4, 5, size=(40, 3))
    code, error = codes.nearest(x, entries)
    for _ in range(6):
        moved = np.sort(rng.choice(40, size=int(rng.integers(0, 12)), replace=False))
        entries = entries.copy()
        entries[moved] += rng.integers(-1, 2, size=(len(moved), 3))
        code, error = codes.reassigned(x, entries, moved, code, error)
        want, d = codes.nearest(x, entries)
        assert (code == want).all() and (error == d).all()


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8) * 2e5], 0) for i in range(60)]
    coded, books = codes.compress(table(spark, rows), entries=5, carry=("label",))
    want, want_books = by_hand(rows, entries=5)
    assert found(coded) == want and books == want_books


def test_refused_and_empty(spark):
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(0, [1.0] * 4, 0), (1, [1.0] * 8, 0)]))
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(0, [1.0] * 6, 0)]))
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(0, [1e9] * 4, 0)]))
    for rows in ([], [(1, None, 0)]):
        coded, books = codes.compress(table(spark, rows, 1), carry=("label",))
        assert coded.count() == 0 and books == [[], [], [], []]
    coded, books = codes.compress(table(spark, [(0, [], 0), (1, [], 1)], 1))
    assert [tuple(r.codes) for r in coded.collect()] == [(0,) * 4] * 2


def test_query_on_a_table_with_every_case(spark, tmp_path):
    rows = mixed()
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in codes.op12_vector_codes(spark, str(tmp_path)).collect()}
    want, books = by_hand(rows)
    labels = {}
    for i, _, label in rows:
        labels.setdefault(i, set()).add(label)
    error = {}
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    by_id = {}
    for (i, c, e) in want:
        by_id.setdefault(i, []).append((c, sum(e)))
    for i, v, label in kept:
        match = by_id[i][0] if len({c for c, _ in by_id[i]}) == 1 else next(m for m in by_id[i] if (m[0] == _code(v, books)))
        error[label] = error.get(label, 0) + match[1]
    text = ",".join(str(c) for part in books for entry in part for c in entry)
    assert {r.codebooks_sha256 for r in codes.op12_vector_codes(spark, str(tmp_path)).select("codebooks_sha256").distinct().collect()} == {
        hashlib.sha256(text.encode()).hexdigest()}
    assert {(c, e) for _, c, e, _ in got} == {("".join(f"{j:02x}" for j in c), sum(e)) for _, c, e in want}
    assert {t for *_, t in got} == set(error.values())


def _code(v, books):
    x = [math.floor(1024 * float(np.float32(c))) for c in v]
    w = len(x) // 4
    return tuple(min((sum((a - b) ** 2 for a, b in zip(x[p * w:(p + 1) * w], e, strict=True)), j) for j, e in enumerate(books[p]))[1] for p in range(4))
