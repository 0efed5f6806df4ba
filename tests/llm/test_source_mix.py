import hashlib
import random
import re
from fractions import Fraction

import pytest

from expkit.llm import op13_source_mix as mixing

SCHEMA = "doc_id long, source string, text string, size long, target string, rank int, before int, one string, DOC_ID_ int, wanted long"


def table(spark, rows, partitions=4):
    return spark.createDataFrame([(i, s, x, 1, "t", 2, 3, "o", 4, 5) for i, s, x in rows], SCHEMA).repartition(partitions)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_hand(sizes, weights, most):
    """Share, cap and share again what is above, in exact fractions, until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        shared = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if shared[s] > most * sizes[s]]
        if not above:
            return out | shared
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def by_hand(rows, weights=(5, 2, 1), most=3):
    sizes = {}
    for _, s, x in rows:
        sizes[s] = sizes.get(s, 0) + words(x)
    target = targets_by_hand(sizes, weights, most)
    out = []
    for s, size in sizes.items():
        own = [(i, words(x)) for i, t, x in rows if t == s]
        certain = int(target[s] / size) if size else 0
        rest = float(target[s]) - certain * size
        p = rest / size if size else None

        def rank(i, p=p):
            u = (int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return u / (1 - u) * (1 - p) / p if p else u

        order = sorted(own, key=lambda r: (rank(r[0]), r[0] is not None, r[0] or 0, r[1]))
        room, tried, chosen, missed = round(rest), 0, set(), []
        for k, (_, n) in enumerate(order):
            if n <= room and tried <= mixing.LOOK:
                room -= n
                chosen.add(k)
            elif tried <= mixing.LOOK:
                missed.append((n, k))
            tried += bool(missed)
        if missed and min(missed)[0] < 2 * room:
            chosen.add(min(missed)[1])
        out += [(i, n, size, round(float(target[s]), 6), (certain + (k in chosen and certain < most)) * n) for k, (i, n) in enumerate(order)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def corpus(rng, n=400, names=("a", "b", "c", "d", "é", "Z", None)):
    rows = []
    for i in range(n):
        source = "a" if rng.random() < 0.4 else rng.choice(names)
        rows.append((i, source, " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 3)))))
    rows += [(n + i, "only nulls", None) for i in range(3)] + [(n + 5, "b", "x\ty\x0bz\n\n"), (n + 6, "b", ""), (None, "a", "no id"), (n + 7, "huge", "w " * 9000)]
    return rows + [rows[3], rows[3], rows[7]] + [(n + 20 + i, "copies", rows[9][2]) for i in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_mix_by_hand(spark, seed):
    rows = corpus(random.Random(seed))
    assert found(mixing.mix(table(spark, rows))) == by_hand(rows)


def test_taken_words_come_near_the_targets_and_no_document_exceeds_its_copies(spark):
    rows = corpus(random.Random(4), 3000)
    got = mixing.mix(table(spark, rows)).collect()
    taken, target, largest = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in target:
        few = s in ("huge", "copies", "only nulls")  # one document, or copies of one; the others have documents of three words
        assert abs(taken[s] - target[s]) <= (largest[s] / 2 if few else 2), (s, taken[s], target[s])


def test_documents_are_drawn_evenly(spark):
    rows = [(i, s, "w " * (1 + i % 7)) for i in range(6000) for s in ("a", "b")]
    got = mixing.mix(table(spark, rows), weights=(1, 2)).where("source = 'a'").collect()
    for k in range(7):  # a gets 2/3 of its words: so does each size, and the ids' order plays no part
        own = [r.copies for r in got if r.size == k + 1]
        assert abs(sum(own) / len(own) - 2 / 3) < 0.06
    half = [r.copies for r in got if r.doc_id < 3000]
    assert abs(sum(half) / len(half) - 2 / 3) < 0.03


def test_reruns_and_other_partitions_agree(spark):
    rows = corpus(random.Random(8))
    assert found(mixing.mix(table(spark, rows, 1))) == found(mixing.mix(table(spark, rows[::-1], 9)))


def test_bounds_and_small_tables(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert found(mixing.mix(table(spark, [(1, "a", None), (2, None, "")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert found(mixing.mix(table(spark, [(1, "a", "x y z")]))) == [(1, 3, 3, 3.0, 3)]
    # One source can't fill its share: the cap, and the rest goes to the other.
    rows = [(1, "a", "x"), (2, "b", "y " * 99)]
    assert found(mixing.mix(table(spark, rows))) == [(1, 1, 1, 3.0, 3), (2, 99, 99, 97.0, 99)]
    with pytest.raises(ValueError):
        mixing.mix(table(spark, rows), weights=())


def test_query(spark, tmp_path):
    rows = corpus(random.Random(6))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op13_source_mix(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and found(got) == by_hand(rows)
