import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from expkit.llm import op11_periodic_runs as runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(words, least_length=6, least_exponent=4):
    """(start, length, period) by comparing at every lag; a stretch's smallest period by trying all smaller ones."""
    found = set()
    n = len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            i = j
            stretch = words[start:start + length]
            if length >= max(least_length, least_exponent * q) and not any(
                    all(stretch[k] == stretch[k + r] for k in range(length - r)) for r in range(1, q)):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row(doc_id, text):
    words = planted(doc_id, text)
    found = by_hand(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *top, top[1] * 1000 // top[2] if found else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(words, found)))


def structured(rng):
    """Words with runs of many periods, nested ones, runs beside each other and broken ones."""
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.randint(0, 30) for _ in range(rng.randint(0, 60))]
        elif kind < 0.8:
            q = rng.choice([1, 2, 3, 5, 17, 31, 32, 33, 40, 63, 64, 65, 90, 130])
            passage = [rng.randint(0, rng.choice([1, 3, 400])) for _ in range(q)]
            if rng.random() < 0.4:  # a run inside the passage
                inner = [rng.randint(0, 2) for _ in range(rng.randint(1, 3))]
                passage = (passage + inner * rng.randint(4, 12))[:q + 30]
            size = int(len(passage) * rng.uniform(3.5, 7))
            stretch = (passage * 8)[:size]
            if rng.random() < 0.3 and stretch:
                stretch[rng.randrange(len(stretch))] = 999
            out += stretch
        else:
            out += [7] * rng.randint(0, 300)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_a_scan_of_all_lags(seed):
    rng = random.Random(seed)
    texts = [structured(rng) for _ in range(4)] + [[], [1], [1] * 6, [1] * 5]
    words = np.array([w for t in texts for w in t], np.int64)
    got = runs.runs_of(words, np.array([len(t) for t in texts]))
    want, begin = [], 0
    for t in texts:
        want += [(begin + a, b, c) for a, b, c in by_hand(t)]
        begin += len(t)
    assert [tuple(r) for r in got.tolist()] == want


def test_fibonacci_and_other_words_full_of_repetition():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(700)]
    for text in (b, thue, [0, 0, 0, 1] * 200, ([0] * 40 + [1]) * 12, ([0, 1] * 20 + [2]) * 9, [i // 7 for i in range(500)]):
        assert [tuple(r) for r in runs.runs_of(np.array(text), np.array([len(text)])).tolist()] == by_hand(text)


def test_stricter_limits():
    text = [1] * 9 + [2, 3] * 5 + [4, 5, 6] * 4 + [8]
    got = runs.runs_of(np.array(text), np.array([len(text)]), least_length=10, least_exponent=5)
    assert [tuple(r) for r in got.tolist()] == by_hand(text, 10, 5)
    with pytest.raises(ValueError):
        runs.runs_of(np.array(text), np.array([len(text)]), least_exponent=3)


def test_long_texts_take_linear_work():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50000, 100000)
    text = np.concatenate([np.full(400000, 5), rng.integers(0, 50000, 300000), np.tile(passage, 4), np.tile([1, 2, 3], 100000)])
    got = {tuple(r) for r in runs.runs_of(text, np.array([len(text)])).tolist()}
    assert (0, 400000, 1) in got and any(b >= 400000 and c == 100000 for _, b, c in got) and any(b >= 300000 and c == 3 for _, b, c in got)


def test_query_equals_brute_force(spark, mixed, tmp_path):
    rng = random.Random(2)
    rows = [r for r in mixed if not r[1] or len(r[1]) < 20000]
    rows += [(1000 + i, " ".join(f"w{x}" for x in structured(rng))) for i in range(60)]
    rows += [(2000 + i, rng.choice([" ", "\t", "\x0b\n", "  ", " "]).join(f"w{rng.randint(0, 90)}" for _ in range(rng.randint(1, 200)))) for i in range(60)]
    rows += [(3000 + i, rows[200 + i % 3][1]) for i in range(30)] + [rows[7], rows[7], (None, "a " * 50)]
    clashing = "doc_id long, text string, runs string, words int, h long, n string, a int, top string"
    documents = spark.createDataFrame([(i, x, "r", 1, 2, "n", 3, "t") for i, x in rows], clashing).repartition(3)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in runs.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((row(i, x) for i, x in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 40


def test_operator_gives_runs_and_texts(spark, table, monkeypatch):
    monkeypatch.setattr(runs, "WORDS_AT_ONCE", 20)
    rows = [(1, "a b a b a b a b c"), (2, None), (3, ""), (4, " x x  x x x x x x x x x x "), (1, "a b a b a b a b c")]
    got = runs.periodic_runs(table(rows), carry=("n", "DOC_ID")).collect()
    seen = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, tuple(r.carried)) for r in got)
    assert seen == sorted([(1, 9, [(0, 8, 2)], "a b c", (2, 11))] * 2 + [(2, 0, [], "", (2, 11)), (3, 0, [], "", (2, 11)), (4, 6, [(0, 6, 1)], "x x", (2, 11))])
    assert runs.periodic_runs(table([])).count() == 0
