"""Ids of many texts at once: the merges of the vocabulary file, worked off on arrays.

Texts that have only characters up to U+00FF are cut into words together, by arrays
over their bytes: a word ends where the kind of character changes.  All other texts
(and those that hold special tokens) are cut one by one.  Arrow finds the distinct
words of the batch.  Their symbols lie in one array, and in each round every word that
can still be merged makes its merge of lowest rank, the leftmost of equal ones, which
is how the tokenizers library gets its ids.  Words of more than ``LONG`` bytes, that would ask
for many rounds, go to the backtracking encoder of ``op10_bpe``.

Encoded words are kept from batch to batch on arrays of at most ``BYTES_KEPT``, so a worker
that goes on to other work holds little; a full table starts anew with the batch's words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .op10_bpe import _LETTERS, _NUMBERS, Prepared, Vocabulary

#: Characters of text that are worked on together, about, and bytes of the longest word merged on arrays.
TOGETHER, LONG = 4 << 20, 64
#: Encoded words kept from batch to batch, and bytes of their arrays.
WORDS_KEPT, BYTES_KEPT = 400_000, 24 << 20

_LATIN = "".join(map(chr, range(256)))
_LOWER = _LATIN.lower().encode("latin-1")
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
#: Of characters up to U+00FF, as the word pattern of ``op10_bpe`` has them.
_KIND_PATTERNS = ((r"[\t\n\x0b\f\r \x85\xa0]", _BLANK), (f"[{_LETTERS}]", _LETTER), (f"[{_NUMBERS}]", _NUMBER))
_KINDS = np.array([next((k for p, k in _KIND_PATTERNS if re.match(p, c)), _OTHER) for c in _LATIN], np.uint8)
_ONE = np.isin(np.arange(256), list(b"stmd"))
#: Rank of what can't be merged.
_NONE = np.int32(2**31 - 1)


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def _changes(of: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    new = np.ones(len(of), bool)
    np.not_equal(of[1:], of[:-1], out=new[1:])
    return new


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-case Latin-1 that ends with two blanks: what is no blank, and where words start."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KINDS[raw]
    starts = _changes(kind) | (kind == _NUMBER)
    # Endings 's, 't, 'm, 'd, 're, 've and 'll are words, where their apostrophe stands alone.
    at = np.flatnonzero((raw[:-2] == ord("'")) & starts[:-2] & (kind[1:-1] == _LETTER))
    a, b = raw[at + 1], raw[at + 2]
    one = _ONE[a]
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    starts[at[one | two] + 1] = False
    starts[at[one] + 2] = True
    starts[at[two] + 3] = True
    return kind != _BLANK, starts


class Merges:
    """The merges of a vocabulary, in a hash table on arrays."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray, bits: int = 18):
        """``pairs``: (left, right) in the order of their ranks; ``made``: the id that each makes."""
        while len(pairs) * 2 > 1 << bits:
            bits += 1
        self.made, self.shift, self.last = made, np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1), np.full(1 << bits, _NONE)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        rank, at = np.arange(len(key), dtype=np.int32), self._slot(key)
        while len(key):
            free = self.key[at] < 0
            self.key[at[free]], self.rank[at[free]] = key[free], rank[free]
            left = self.key[at] != key
            key, rank, at = key[left], rank[left], at[left] + 1 & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair."""
        key = left << 32 | right
        at = self._slot(key)
        found = self.key[at]
        rank = np.where(found == key, self.rank[at], _NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at = at[todo] + 1 & self.last if len(at) == len(rank) else at + 1 & self.last
            found = self.key[at]
            hit = found == key[todo]
            rank[todo[hit]] = self.rank[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        return rank


def _buffers(words: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """The bytes of words, one behind the other, and their bounds."""
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return (words.buffers()[2].to_pybytes() if len(words) else b"")[bounds[0] : bounds[-1]], bounds - bounds[0]


class _Words:
    """Different words and their ids, on arrays."""

    def __init__(self, words: pa.LargeBinaryArray, ids: np.ndarray, n: np.ndarray):
        self.words, self.ids, self.n, self.first = words, ids, n, np.cumsum(n) - n

    @staticmethod
    def none(id_type: type) -> _Words:
        return _Words(pa.array([], pa.large_binary()), np.empty(0, id_type), np.empty(0, np.int64))

    def too_many(self) -> bool:
        return len(self.words) > WORDS_KEPT or self.words.nbytes + self.ids.nbytes + 2 * self.n.nbytes > BYTES_KEPT

    def gathered(self, number: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, one behind the other."""
        n = self.n[number]
        at = np.repeat(self.first[number] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.ids[at]

    def with_words(self, words: pa.LargeBinaryArray, spelled) -> tuple[_Words, np.ndarray]:
        """These and, spelled, the other different ones; and the number of each."""
        number = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = number < 0
        number[new] = len(self.words) + np.arange(np.count_nonzero(new))
        fresh = words.filter(pa.array(new))
        ids, n = spelled(fresh)
        return _Words(pa.concat_arrays([self.words, fresh]), np.concatenate([self.ids, ids]), np.concatenate([self.n, n])), number


class BatchEncoder(Prepared):
    """The ids of whole batches of texts."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        super().__init__(d)
        ids, mark = d["model"]["vocab"], d["model"]["end_of_word_suffix"] or ""
        # The ids of a byte, and of one that ends a word.
        self.inner, self.final = (np.array([ids.get(c + end, -1) for c in self.visible.values()]) for end in ("", mark))
        pairs = [p if isinstance(p, list) else p.split(" ") for p in d["model"]["merges"]]
        self.merges = Merges(np.array([(ids[a], ids[b]) for a, b in pairs], np.int64).reshape(-1, 2), np.array([ids[a + b] for a, b in pairs], np.int64))
        self.definition, self.by_one = definition, None
        # By the Latin-1 bytes of a word.
        self.known = _Words.none(self.id_type)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or i + 1 == len(texts):
                yield from self._encoded(texts[first : i + 1])
                first, size = i + 1, 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        latin = [_latin(x) if self.plain_words_of is not None and "<|" not in x else None for x in texts]
        plain = iter(self._of_latin([x for x in latin if x is not None]))
        other = iter(self._of_others([x for x, known in zip(texts, latin, strict=True) if known is None]))
        return [next(other if known is None else plain) for known in latin]

    def _of_latin(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        text = (b"\n".join(texts) + b"\n\n").translate(_LOWER)
        keep, starts = cut(text)
        data, starts = np.frombuffer(text, np.uint8)[keep], np.flatnonzero(starts[keep])
        length = np.array([len(x) + 1 for x in texts])
        ends = np.add.reduceat(keep, np.cumsum(length) - length, dtype=np.int64).cumsum()
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        known, number = self.known.with_words(coded.dictionary, self._spelled_latin)
        if known.too_many():
            own = _Words(coded.dictionary, known.gathered(number), known.n[number])
            self.known = _Words.none(self.id_type) if own.too_many() else own
        else:
            self.known = known
        return self._joined(known, number[coded.indices.to_numpy()], np.searchsorted(starts, ends))

    def _spelled_latin(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        latin, bounds = _buffers(words)
        high = np.append(0, np.cumsum(np.frombuffer(latin, np.uint8) >= 128))
        return self.spelled(latin.decode("latin-1").encode(), np.diff(bounds + high[bounds]))

    def _of_others(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        words = [[w for p in self.pieces(x) for w in ([p] if p in self.special else self.words(p))] for x in texts]
        coded = pa.array([w.encode() for x in words for w in x], pa.large_binary()).dictionary_encode()
        utf8, bounds = _buffers(coded.dictionary)
        return self._joined(_Words(coded.dictionary, *self.spelled(utf8, np.diff(bounds))), coded.indices.to_numpy(), np.cumsum([len(x) for x in words]))

    def _joined(self, known: _Words, number: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, given the number of each of their words and the end of each text."""
        return np.split(known.gathered(number), np.append(0, np.cumsum(known.n[number]))[ends[:-1]])

    def spelled(self, words: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of these sizes, one behind the other, and the number of ids of each."""
        data, ends = np.frombuffer(words, np.uint8), np.cumsum(size)
        ids, of = self.inner[data], np.repeat(np.arange(len(size), dtype=np.int32), size)
        ids[ends - 1] = self.final[data[ends - 1]]
        by_one = size > LONG
        for content in map(str.encode, self.special):
            if content in words:
                by_one |= np.array([words[b - n : b] == content for b, n in zip(ends.tolist(), size.tolist(), strict=True)], bool)
        done = [self._spelled_by_one(words[ends[i] - size[i] : ends[i]].decode(), i) for i in np.flatnonzero(by_one)]
        if len(done):
            left = ~np.repeat(by_one, size)
            ids, of = ids[left], of[left]
        if (ids < 0).any():
            raise ValueError("the vocabulary cannot spell some byte")
        rank = np.full(len(ids), _NONE)
        pair = np.flatnonzero(of[1:] == of[:-1])
        rank[pair] = self.merges.ranks(ids[pair], ids[pair + 1])
        while len(ids):
            first = np.flatnonzero(_changes(of))
            n = np.diff(first, append=len(of))
            least = np.minimum.reduceat(rank, first)
            each = np.repeat(least, n)
            ready = each == _NONE
            done.append((of[ready], ids[ready]))
            # The leftmost of each word's merges of lowest rank.
            at = np.flatnonzero((rank == each) & ~ready)
            at = at[_changes(of[at])]
            ids[at] = self.merges.made[rank[at]]
            keep = ~ready
            keep[at + 1] = False
            ids, rank, of, at = ids[keep], rank[keep], of[keep], np.cumsum(keep)[at] - 1
            rank[at] = _NONE
            after = at[at + 1 < len(of)]
            after = after[of[after + 1] == of[after]]
            before = at[at > 0] - 1
            before = before[of[before] == of[before + 1]]
            pair = np.concatenate([before, after])
            rank[pair] = self.merges.ranks(ids[pair], ids[pair + 1])
        of, ids = (np.concatenate(x) for x in zip((np.empty(0, np.int32), np.empty(0, np.int64)), *done, strict=True))
        return ids[np.argsort(of, kind="stable")].astype(self.id_type), np.bincount(of, minlength=len(size))

    def _spelled_by_one(self, word: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        if word in self.special:
            ids = [self.special[word]]
        else:
            self.by_one = self.by_one or Vocabulary(self.definition)
            ids = self.by_one.encode_word(word)
        return np.full(len(ids), i, np.int32), np.array(ids, np.int64)
