import hashlib
import re
from collections import Counter

import pytest

from expkit.llm import op3_exact_dedup as exact
from expkit.llm import op9_line_dedup as lines


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact_by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in rows]
    ids, size = {}, Counter(norm)
    for (i, _), t in zip(rows, norm, strict=True):
        if i is not None:
            ids[t] = min(i, ids.get(t, i))
    return {(i, ids.get(t), size[t], sha(t)) for (i, _), t in zip(rows, norm, strict=True)}, len(size)


@pytest.mark.parametrize("hot", [512, 2])
def test_exact_groups(table, mixed, monkeypatch, hot):
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    got = exact.exact_groups(table(mixed)).collect()
    want, groups = exact_by_hand(mixed)
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert len(got) == len(mixed)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == groups


def test_exact_groups_of_nothing(table):
    assert exact.exact_groups(table([])).count() == 0


def lines_by_hand(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    found = {}
    for i, x in rows:
        for k in map(key, (x or "").split("\n")):
            found.setdefault(k, set()).add(i)
    drop = {k for k, d in found.items() if k and len(d) >= least}
    out = []
    for i, x in rows:
        parts = (x or "").split("\n")
        left = [p for p in parts if key(p) not in drop]
        out.append((i, len(parts), len(parts) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("least,batches,share", [(10, 4, 4096), (3, 7, 40), (2, 1, 4096)])
def test_line_dedup(table, mixed, monkeypatch, least, batches, share):
    monkeypatch.setattr(lines, "HOT_SHARE", share)
    rows = [*mixed, *((300 + i, f" Common LINE\t\nown {i}\r\n\nCOMMON line") for i in range(15))]
    got = lines.dedup_lines(table(rows), min_docs=least, batches=batches, fanout=2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(lines_by_hand(rows, least))


def test_runs_are_compacted_and_saturated_lines_stay_out(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(batch * 10 + d, 1, 1) for d in range(4)] + [(batch * 10, 2, batch)], "doc_id long, h1 long, h2 long"))
    assert runs.compactions >= 2 and all(len(level) < 2 for level in runs.levels)
    assert {(r.h1, r.h2): r.n_docs for r in runs.frequent().collect()} == {(1, 1): 4}


def test_lines_of_nothing(table):
    assert lines.dedup_lines(table([])).count() == 0
