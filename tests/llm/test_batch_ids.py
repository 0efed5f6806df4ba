import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from test_bpe import odd_texts

from expkit.llm import batch_ids
from expkit.llm import op8_packing as packing
from expkit.llm.op10_bpe import read_definition, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def texts():
    rng = random.Random(9)
    yield from odd_texts()
    for alphabet in ("sstmdrevl'' '-1éßA\n\xa0\x85².\x1c", "ab'é "):
        yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500))
    yield from ["x" * (batch_ids.LONG + 1), "é" * 40, "-" * 500 + "'s", "<|endoftext|><|endoftext|>", "日本" * 60]


@pytest.mark.parametrize("together", [1, 500, 1 << 22])
def test_same_ids_as_the_library(library, monkeypatch, together):
    monkeypatch.setattr(batch_ids, "TOGETHER", together)
    monkeypatch.setattr(batch_ids, "WORDS_KEPT", 50)
    encoder, some = batch_ids.BatchEncoder(read_definition(tokenizer_path())), list(texts())
    some = some[:: 1 if together > 1 else 10]
    for text, got in zip(some, encoder.encode_all(some), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.known.words) <= 50 or together > 500


def test_a_word_is_merged_once(monkeypatch):
    encoder = batch_ids.BatchEncoder(read_definition(tokenizer_path()))
    asked, spelled = [], encoder.spelled
    monkeypatch.setattr(encoder, "spelled", lambda words, size: asked.append(len(size)) or spelled(words, size))
    for _ in range(3):
        got = list(encoder.encode_all(["some words, some Words and others"] * 200))
        assert len(got) == 200 and all(np.array_equal(x, got[0]) for x in got)
    assert asked == [5, 0, 0]


def test_a_worker_keeps_little_of_many_words():
    encoder = batch_ids.BatchEncoder(read_definition(tokenizer_path()))
    rng = random.Random(6)
    list(encoder.encode_all(["warm up"]))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for _ in range(5):
        for _ in encoder.encode_all([" ".join("".join(rng.choices("abcdefghijklmnop", k=8)) + "." for _ in range(40)) for _ in range(1500)]):
            pass
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    # 300,000 different words; tables of strings and bytes took 106 MB.
    assert len(encoder.known.words) > 290_000
    assert kept < 30e6


def test_long_words_are_not_kept(monkeypatch):
    monkeypatch.setattr(batch_ids, "BYTES_KEPT", 10_000)
    encoder = batch_ids.BatchEncoder(read_definition(tokenizer_path()))
    first, second = encoder.encode_all(["." * 20_000, "word"])
    assert len(encoder.known.words) <= 1 and len(first) > 0 and len(second) == 1


def test_nothing():
    encoder = batch_ids.BatchEncoder(read_definition(tokenizer_path()))
    assert list(encoder.encode_all([])) == []
    assert [len(x) for x in encoder.encode_all(["", " ", ""])] == [0, 0, 0]


def test_neighbours_are_those_of_a_plain_search():
    rng = np.random.default_rng(4)
    # Few documents hold a rare term, most a frequent one; both kinds count.
    tails = [np.r_[rng.integers(0, 30, rng.integers(0, 25)), rng.integers(30, 4000, rng.integers(0, 40))].astype(np.uint16) for _ in range(300)]
    index, unused = packing.ShardIndex(tails), np.ones(300, bool)
    assert 0 < np.count_nonzero(index.row >= 0) < len(index.row)
    held = [dict(zip(*np.unique(t, return_counts=True), strict=True)) for t in tails]
    found, mean = np.bincount(np.concatenate([list(h) for h in held]).astype(int)), np.mean([len(t) for t in tails])
    for seed in range(300):
        unused[[seed, *rng.integers(0, 300, 3)]] = False
        score = np.zeros(300)
        for i in np.flatnonzero(unused):
            norm = packing.K1 * (1 - packing.B + packing.B * len(tails[i]) / mean)
            for t in held[seed].keys() & held[i].keys():
                n = held[i][t]
                score[i] += np.log(1 + (300 - found[t] + 0.5) / (found[t] + 0.5)) * n * (packing.K1 + 1) / (n + norm)
        got = index.neighbours(seed, unused)
        assert sorted(got.tolist()) == np.flatnonzero(score).tolist()
        assert np.all(np.diff(score[got]) <= 1e-9)
