import hashlib
import random

import numpy as np
import pytest

from expkit.llm import op10_bpe as bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.Vocabulary(bpe.read_definition(bpe.tokenizer_path())), Tokenizer.from_file(bpe.tokenizer_path())


def odd_texts():
    rng = random.Random(2)
    yield from ["", " ", "a", "\0 a\0", "x\x1cy\x1d z\x85w\xa0v", "ΑΣ ΣΑΣ İ ǅ ﬁ", "é é ñ", "a" * 3000, "ab" * 2000, "don't I'LL 's's ''s", "日本語 123 ٣", "🙂👍🏽",
                "<|endoftext|>a<|startoftext|> <|endoftext|", "<|ENDOFTEXT|>", " a b　c​d"]
    for alphabet in ("ab", "the in an er", "abcdefghijklmnopqrstuvwxyz'  \n0123éßñ-_.Σ<|>"):
        yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300))


def test_same_ids_and_text_as_the_library(both):
    own, library = both
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False), text


def test_tables_start_anew(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    for text in ("some words that do not stay", "other words, and others still"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 6


def test_query_rows(table, mixed, both):
    _, library = both
    got = bpe.digests(table(mixed), bpe.tokenizer_path()).collect()
    want = []
    for i, x in mixed:
        ids = library.encode(x or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_round_trip_rows(table, both):
    own, library = both
    row = bpe.round_trip(table([(1, "Hello, World")]), bpe.tokenizer_path()).first()
    assert row.ids == library.encode("Hello, World", add_special_tokens=False).ids
    assert row.decoded == own.decode(np.array(row.ids)).decode()


def test_nothing(table):
    assert bpe.digests(table([]), bpe.tokenizer_path()).count() == 0
