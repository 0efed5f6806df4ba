import random
import zlib

import numpy as np
import pytest
from conftest import prose

from expkit.llm import op6_toxicity as toxicity


def forward_backward_by_hand(emission, start, step):
    """Marginals of one chain by enumeration."""
    n = len(emission)
    weight = {}
    for path in range(1 << n):
        s = [(path >> i) & 1 for i in range(n)]
        w = start * s[0] + sum(e * x for e, x in zip(emission, s, strict=True)) + sum(step[a][b] for a, b in zip(s, s[1:], strict=False))
        weight[tuple(s)] = np.exp(w)
    z = sum(weight.values())
    return [sum(w for s, w in weight.items() if s[i]) / z for i in range(n)]


def test_marginals_and_expected_transitions():
    rng = np.random.default_rng(0)
    step, start = np.array([[0.1, -1.0], [0.4, 0.7]]), -0.5
    rows = rng.normal(size=(3, 7))
    mask = np.ones((3, 7), bool)
    mask[1, 4:] = False
    p, counts = toxicity.marginals(rows, mask, start, step, expected=True)
    for r, n in ((0, 7), (1, 4), (2, 7)):
        assert p[r, :n] == pytest.approx(forward_backward_by_hand(rows[r, :n], start, step))
    assert counts.sum() == pytest.approx(6 + 3 + 6)


def test_marginals_of_a_whole_text_do_not_depend_on_its_segments(monkeypatch):
    rng = np.random.default_rng(4)
    step, start = np.array([[0.1, -1.0], [0.4, 0.7]]), -0.5
    texts = [rng.normal(size=n) for n in (5, 12, 1, 4, 8, 9, 0, 11)]
    for size in (3, 4, 64):
        monkeypatch.setattr(toxicity, "SEGMENT", size)
        rows, mask, doc = toxicity.segments(texts, 0.0)
        p, counts = toxicity.marginals(rows, mask, start, step, expected=True, first=np.diff(doc, prepend=-1) != 0)
        for d, x in enumerate(texts):
            if len(x):
                assert p[doc == d].reshape(-1)[: len(x)] == pytest.approx(forward_backward_by_hand(x, start, step))
        assert counts.sum() == pytest.approx(sum(len(x) - 1 for x in texts if len(x)))


def test_scores_equal_a_chain_by_hand(labelled, monkeypatch):
    """Document scores from marginals by enumeration, token by token, with the model's weights."""
    docs, labels = labelled
    truth = dict(labels)
    model = toxicity.Model(0.2).fit([x for i, x in docs[:200] if truth[i]], [x for i, x in docs[:200] if not truth[i]])
    monkeypatch.setattr(toxicity, "SEGMENT", 5)
    texts = [" ".join(x.split()[:12]) for _, x in docs[200:230]] + ["", "vilekor", "lorem"]
    scores, each = model.scored(texts)
    for x, score, p in zip(texts, scores, each, strict=True):
        emission = [sum(float(model.weights[zlib.crc32(f.encode()) % toxicity.SLOTS]) for f in toxicity.features(toxicity.normal(t))) + model.bias for t in x.split()]
        want = forward_backward_by_hand(emission, model.start, model.step) if emission else []
        assert list(p) == pytest.approx(want, abs=1e-5)
        top, total = max([1e-6, *want]), 1e-6 + sum(want)
        top = min(top, 1 - 1e-6)
        z = model.document[0] + model.document[1] * np.log(top / (1 - top)) + model.document[2] * np.log(total)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    bad = ["vilekor", "grosumt", "nastibel"]
    docs, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randint(5, 60)).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "en", "ish", ","]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, table, labelled):
    docs, labels = labelled
    more = [(2000, None), (2001, ""), (2002, "x" * 50_000), (None, "nothing of note"), docs[3], docs[3]]
    df = table([*docs, *more])
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, marks)).collect()
    assert len(got) == len(docs) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth, held = dict(labels), [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].predicted == truth[i] for i in held]) > 0.98
    spans = [dict(docs)[i][s.start : s.end] for i in held if truth[i] for s in by_id[i].offsets]
    assert spans and all(s.startswith(("vile", "gros", "nasti")) for s in spans)


def test_labels_of_held_out_documents_do_not_count(spark, table, labelled):
    docs, labels = labelled
    df = table(docs[:300])
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(df, toxicity.fit(df, spark.createDataFrame(m, "doc_id long, toxic int"))).collect())
              for m in (labels, turned)]
    assert scores[0] == scores[1]


def test_equal_texts_count_once_before_the_limit(spark, table):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "a copy") for i in ids[:40]] + [(i, f"text {i}") for i in ids[40:48]] + [(i, f"clean {i}") for i in ids[48:60]] + [(ids[60], "a copy")]
    marks = [(i, 1) for i in ids[:48]] + [(i, 0) for i in ids[48:61]]
    sample, _ = toxicity.training_texts(table(rows), spark.createDataFrame(marks, "doc_id long, toxic int"), per_class=9)
    chosen = sample.collect()
    seen = {"toxic": [r.text for r in chosen if r.toxic == 1], "clean": [r.text for r in chosen if r.toxic == 0]}
    assert sorted(seen["toxic"]) == sorted(["a copy", *(f"text {i}" for i in ids[40:48])])
    assert len(seen["clean"]) == 9 and "a copy" not in seen["clean"]


def test_without_labels_or_documents(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = table([(1, "a b"), (2, None)])
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, one)).collect()} == {1.0}
    empty = table([])
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
