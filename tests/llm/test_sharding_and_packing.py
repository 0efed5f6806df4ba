import random
import zlib

import numpy as np
import pytest
from conftest import prose

from expkit.llm import op5_sharding as sharding
from expkit.llm import op8_packing as packing
from expkit.llm.op10_bpe import tokenizer_path


@pytest.mark.parametrize("n_shards", [1, 4, 16])
def test_shards_are_contiguous_balanced_and_gapless(table, mixed, n_shards):
    got = sharding.shard_by_bytes(table(mixed), n_shards).collect()
    assert len(got) == len(mixed)
    sizes = sorted(len((x or "").encode()) + 1 for _, x in mixed)
    assert sorted(r["size"] for r in got) == sizes
    got.sort(key=lambda r: r.byte_offset)
    at = 0
    for r in got:
        assert r.byte_offset == at and r.shard == min(n_shards - 1, at * n_shards // sum(sizes))
        at += r["size"]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    slots = {}
    for r in got:
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
    texts = {}
    for i, x in mixed:
        texts.setdefault(i, set()).add(zlib.crc32((x or "").encode()))
    assert all(r.text_crc32 in texts[r.doc_id] for r in got)


def test_shards_of_nothing(table):
    assert sharding.shard_by_bytes(table([])).count() == 0


def test_pieces_hold_every_id_once_in_full_windows(table, mixed):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    rows = [*mixed, *((1000 + i, prose(rng, rng.randint(5, 300))) for i in range(200))]
    got = packing.pack(table(rows), tokenizer_path(), window=256, slack=8, shard_docs=100, with_ids=True).collect()
    want = sorted((str(i), [*library.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows)
    pieces = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append(r)
    single = [i for i, _ in rows if i is not None and sum(j == i for j, _ in rows) == 1]
    by_id = dict(want)
    for i in single:
        assert [t for r in pieces[i] for t in r.ids] == by_id[str(i)]
        assert all(r.doc_tokens == len(by_id[str(i)]) for r in pieces[i])
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    windows = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == windows.get(r.sequence_id, 0)
        windows[r.sequence_id] = r.offset + r.length
    assert max(windows.values()) <= 256
    assert sum(n < 256 - 8 for n in windows.values()) <= len({s >> 32 for s in windows})


def test_neighbours_share_rare_words():
    rng = random.Random(3)
    tails = [np.array(sorted(rng.sample(range(400), 20))) for _ in range(40)]
    tails[7] = np.r_[tails[7], [500, 501, 502, 503, 504, 505]]
    tails[31] = np.r_[tails[31], [500, 501, 502, 503, 504, 505]]
    index = packing.ShardIndex(tails)
    unused = np.ones(40, bool)
    unused[7] = False
    assert index.neighbours(7, unused)[0] == 31
    unused[31] = False
    assert 31 not in index.neighbours(7, unused)


def _shards(rows, got):
    """Where each document of ``rows`` was packed."""
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    return {r.doc_id: r.sequence_id >> 32 for r in got}


def test_documents_are_placed_by_content(table):
    rng = random.Random(17)
    # 40 subjects with words of their own, 10 documents of each, ids dealt at random.
    subjects = [[f"{''.join(rng.choice('bcdfgklmnprst') + rng.choice('aeiou') for _ in range(3))}" for _ in range(25)] for _ in range(40)]
    subject = [i % 40 for i in range(400)]
    rng.shuffle(subject)
    rows = [(i, " ".join(rng.choice(subjects[s]) for _ in range(60))) for i, s in enumerate(subject)]
    shard = _shards(rows, packing.pack(table(rows), tokenizer_path(), window=512, shard_docs=40).collect())
    assert len(set(shard.values())) > 5
    pairs = [(i, j) for i in range(400) for j in range(i) if subject[i] == subject[j]]
    # Dealt by id hash, about one pair in ten meets.
    assert sum(shard[i] == shard[j] for i, j in pairs) > 0.5 * len(pairs)


def test_terms_weigh_the_same_in_every_shard():
    tails = [np.array([1, 2, 3]), np.array([1, 4]), np.array([1, 2])]
    found = np.zeros(6, np.int64)
    found[[1, 2, 3, 4]] = [900, 5, 300, 2]
    corpus = packing.Corpus(1000, 4.0, found)
    whole, part = packing.ShardIndex(tails, corpus), packing.ShardIndex(tails[:1], corpus)
    assert np.allclose(part.weight, whole.weight[whole.doc == 0])
    assert packing.Corpus.counts(tails)[1].tolist() == [3, 2, 1, 1]


def _windows(ids, window, slack=4):
    """The documents of each window, in order."""
    windows = {}
    for i, _, _, sequence, _ in packing.pack_shard(ids, window, slack):
        windows.setdefault(sequence, []).append(i)
    return windows


def test_related_documents_fill_the_window_beyond_any_number_of_them():
    # 120 short documents of the seed's subject fill its window; the longer strangers wait.
    related = [np.array([10, 11, 12 + i, packing.CLOSING_ID]) for i in range(120)]
    strangers = [np.arange(1000 + 40 * i, 1040 + 40 * i) for i in range(40)]
    strangers = [np.r_[x, packing.CLOSING_ID] for x in strangers]
    windows = _windows([*related, *strangers], 480)
    assert sorted(windows[0]) == list(range(120))


def test_every_term_of_the_seed_finds_neighbours():
    # The seed shares 40 rare terms with document 1 and one common term with documents 2 to 9.
    seed = np.r_[np.arange(100, 140), 50, packing.CLOSING_ID]
    others = [np.r_[np.arange(100, 140), packing.CLOSING_ID], *(np.r_[50, 500 + i, packing.CLOSING_ID] for i in range(8))]
    strangers = [np.r_[np.arange(1000 + 7 * i, 1007 + 7 * i), packing.CLOSING_ID] for i in range(20)]
    windows = _windows([seed, *others, *strangers], 42 + 41 + 8 * 3)
    assert sorted(windows[0]) == list(range(10))


def test_packing_of_nothing(table):
    assert packing.pack(table([]), tokenizer_path()).count() == 0
