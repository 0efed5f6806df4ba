import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from expkit.llm import components as cc
from expkit.llm import op2_suffix_dedup as repeats
from expkit.llm import op4_ngram_join as near
from expkit.llm import suffixes


def removal_by_hand(rows, length=suffixes.LENGTH):
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for k in range(len(b) - length + 1):
            if i is not None:
                w = b[k : k + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, x in rows:
        b = (x or "").encode()
        lost = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first.get(b[k : k + length], i) < i:
                lost[k : k + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(lost)))
        kept = bytes(c for c, gone in zip(b, lost, strict=True) if not gone)
        out.append((i, len(b), sum(lost), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(mixed):
    """Shared passages, their edges, periodic text and texts just around the shortest repeat."""
    rng = random.Random(9)
    rows = [r for r in mixed if r[0] != 137]
    common = prose(rng, 14)
    rows += [(500 + i, prose(rng, rng.randint(0, 6)) + common[: rng.randint(45, len(common))] + prose(rng, 3)) for i in range(40)]
    rows += [(600 + i, "ab" * (20 + i)) for i in range(12)] + [(700 + i, "z" * (48 + i)) for i in range(5)]
    rows += [(720, prose(rng, 20)[:50])]
    rows += [(721, rows[-1][1]), (722, "q" + rows[-1][1]), (723, rows[-1][1][1:])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"batch_docs": 16, "bucket_docs": 20}, {"batch_docs": 8, "bucket_docs": 10, "hot_batches": 2}])
def test_repeated_bytes_leave_later_documents(table, mixed, sizes):
    rows = passages(mixed)
    got = repeats.suffix_dedup(table(rows), **sizes).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removal_by_hand(rows)


def test_texts_longer_than_a_piece(table, monkeypatch):
    rng = random.Random(4)
    long = prose(rng, 400)
    rows = [(1, long), (2, prose(rng, 100) + long[700:2500] + prose(rng, 50)), (3, long + "!")]
    whole = removal_by_hand(rows)
    monkeypatch.setattr(suffixes, "PIECE", 512)
    texts = [np.frombuffer(x.encode(), np.uint8) for _, x in rows]
    s = suffixes.Segments(texts)
    covered = np.zeros(len(texts[0]), bool)
    for a, n in zip(s.first[s.text == 0], s.size[s.text == 0], strict=True):
        covered[a : a + n] = True
    assert covered.all()
    monkeypatch.undo()
    got = repeats.suffix_dedup(table(rows), with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == whole
    assert {r.doc_id: bytes(r.kept) for r in got}[1] == long.encode()


def test_intervals_of_the_common_prefix_tree():
    common = np.array([0, 60, 70, 55, 0, 80, 10])
    assert sorted(suffixes.intervals(common)) == [(0, 3, 60), (0, 4, 55), (1, 3, 70), (4, 6, 80)]


def test_removal_of_nothing(table):
    assert repeats.suffix_dedup(table([])).count() == 0


def near_by_hand(rows, threshold=0.8):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "").strip(" ").lower()
    rep, links, root = {}, Counter(), {}
    for i, x in rows:
        if i is not None:
            rep[norm(x)] = min(i, rep.get(norm(x), i))
    sets = {}
    for t, i in rep.items():
        w = t.split(" ") if t else []
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i
    ids = sorted(sets)
    find = lambda i: i if root[i] == i else find(root[i])
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((i, rep[norm(x)], find(rep[norm(x)]), links[rep[norm(x)]], find(rep[norm(x)]) == i) if i is not None else (None, None, None, 0, True)
                   for i, x in rows)


@pytest.mark.parametrize("cell", [512, 4])
def test_near_copies(table, mixed, cell):
    rng = random.Random(11)
    base = prose(rng, 80).split(" ")
    rows = list(mixed)
    for i in range(40):  # one large group of near copies, some linked and some not
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((800 + i, " ".join(w)))
    got = near.jaccard_classes(table(rows), cell=cell).collect()
    assert Counter((r.doc_id, r.rep_id, r.class_id, r.n_links, r.kept) for r in got) == near_by_hand(rows)


@pytest.mark.parametrize("cell", [512, 2])
def test_one_id_on_two_texts(table, cell):
    rng = random.Random(13)
    first, second = prose(rng, 60), prose(rng, 60)
    rows = [(1, first), (1, second), (5, first + " a"), (6, second + " b"), (7, second + " c"), (8, first + " d")]
    got = near.jaccard_classes(table(rows), cell=cell).collect()
    # Both texts have their own links: two for the first, two for the second.
    assert sorted((r.doc_id, r.rep_id, r.class_id, r.n_links, r.kept) for r in got) == [
        (1, 1, 1, 2, True), (1, 1, 1, 2, True), (5, 5, 1, 2, False), (6, 6, 1, 2, False), (7, 7, 1, 2, False), (8, 8, 1, 2, False)]


def test_bands_reach_the_recall():
    for threshold, rows, recall in ((0.8, 8, 0.999), (0.5, 3, 0.9), (0.9, 12, 0.99)):
        b = near.bands(threshold, rows, recall)
        assert 1 - (1 - threshold**rows) ** b >= recall > 1 - (1 - threshold**rows) ** (b - 1)


def test_near_copies_of_nothing(table):
    assert near.jaccard_classes(table([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (299, 298)]
    got = {r.id: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))
    assert got[300] == got[299] == got[298] == 298 and 200 not in got


@pytest.mark.parametrize("recall", [0.2, 0.999])
def test_links_do_not_depend_on_the_size_of_cells(table, recall):
    """Few bands, so that many similar pairs share none: what counts as a link is the same at every cell size."""
    rng = random.Random(17)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    found = [sorted((r.doc_id, r.class_id, r.n_links) for r in near.jaccard_classes(table(rows), cell=cell, recall=recall).collect()) for cell in (512, 8, 2)]
    assert found[0] == found[1] == found[2]
    assert (sum(n for *_, n in found[0]) < sum(n for _, _, _, n, _ in near_by_hand(rows))) == (recall < 0.5)


def test_one_row_of_each_class_stays(table):
    rng = random.Random(19)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(3, b), (4, b), (1, a), (3, a), (1, a), (1, " " + a.upper()), (5, a + " x"), (None, a), (None, a), (6, c), (6, c), (7, None), (8, "")]
    kept = near.one_of_each_class(table(rows))
    got = sorted(((r[0], (r[1] or "").strip().lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (6, c), (None, a), (None, a), (7, "")], key=repr)
    assert kept.columns == table(rows).columns
