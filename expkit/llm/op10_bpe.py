"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word's symbols end with a word-end mark.  An Aho-Corasick automaton of all
tokens gives, in one pass, the tokens that end at each position of the word,
from which the longest token at each start follows.  The encoder walks forward,
taking the longest token that is compatible with the token before it, or else
the next shorter one; where none fits it steps back and marks the position as a
dead end, so each position is given up at most once.  Two tokens are compatible
if merging their concatenation from scratch keeps the border between them: the
pair is undone along the split of the merge that made each token, and no split
may offer a merge of lower rank over the border.  A sequence with compatible
neighbours only is the one that the merges give.  Checked pairs are kept in a
table.

Words repeat, so each Python worker keeps a bounded table of encoded words.
Decoding gathers token strings from one byte string by their offsets.

Text is first prepared as the vocabulary file asks: special tokens cut out, NFC,
white space runs to one space, lower case, split into words, bytes to visible
characters.  The file is read on the driver and sent out once (under 2 MB).

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows come out repeated; an empty table gives no rows; other
columns are ignored.  Rows are independent: no shuffle.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Encoded words (and texts between white space) kept by a worker; a table starts anew when it is full.
WORDS_KEPT = 600_000
PAIRS_KEPT = 1_000_000
VOCABULARY = "word_bpe_49k.json"

#: White space as the normaliser and the word pattern understand it.
_SPACE = r"[\t\n\x0b\f\r \x85\xa0  -     　]"
# Fixed value: the word pattern of the vocabulary file; where a text has only
# characters up to U+00FF, _PLAIN_WORDS finds the same words faster.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WORDS = rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t\n\x0b\f\r \x85\xa0]+"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile(r"[^\x00-\xff]")
# A word end that no mapped byte can be.
_END = "\0"


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    table = {b: chr(b) for b in own}
    others = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(others)})
    return [table[b] for b in range(256)]


class Prepared:
    """Text made ready as a vocabulary file asks."""

    def __init__(self, d: dict):
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*d["model"]["vocab"].values(), *self.special.values()], default=-1) + 1
        self.id_type = np.uint16 if size <= 1 << 16 else np.uint32
        self.visible = dict(enumerate(_byte_characters()))
        pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(pattern.replace(r"\s", _SPACE[1:-1])).findall
        self.plain_words_of = re.compile(_PLAIN_WORDS).findall if pattern == _WORDS else None
        self.spaces = regex.compile(_SPACE + "+").sub
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _BEYOND.search(text):
                text = self.spaces(" ", text)
                # One character at a time where a sigma is: no final sigma.
                return self.words_of("".join(map(str.lower, text)) if "\u03a3" in text else text.lower())
        # All kinds of white space only part words here.
        return (self.plain_words_of or self.words_of)(text.lower())

    def pieces(self, text: str) -> list[str]:
        """The text cut at its special tokens, which are pieces of their own."""
        return self.specials.split(text) if self.specials is not None and "<|" in text else [text]


class Vocabulary(Prepared):
    """A word-end BPE vocabulary with its automaton and tables."""

    def __init__(self, definition: str):
        import ahocorasick

        d = json.loads(definition)
        super().__init__(d)
        model, self.mark = d["model"], d["model"]["end_of_word_suffix"]
        ids = {self._inner(t): i for t, i in model["vocab"].items()}
        for content in self.special:
            ids.pop(content, None)
        # Rank of the merge of two tokens; rank and parts of the merge that makes a token (-1: none does).
        top = max(ids.values(), default=-1) + 1
        self.merge: dict[int, int] = {}
        self.rank, self.left, self.right = [-1] * top, [0] * top, [0] * top
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self._inner(left), self._inner(right)
            made = ids[left + right]
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, ids[left], ids[right]
            self.merge[ids[left] << 32 | ids[right]] = self.rank[made]
        self.length, self.shorter = [0] * top, [None] * top
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        # The next shorter token with which each token starts.
        for t, i in ids.items():
            self.length[i] = len(t)
            self.shorter[i] = next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), None)

        size = max([*ids.values(), *self.special.values()], default=-1) + 1
        names = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            names[i] = t
        self.id_code = self.id_type().dtype.char
        self.strings = _Strings(names)
        self.digits = _Strings([str(i) for i in range(size)])

        self.pairs: dict[int, bool] = {}
        self.known, self.chunks = _Kept(self.packed_word), _Kept(self.packed_chunk)

    def _inner(self, token: str) -> str:
        return token.removesuffix(self.mark) + _END if self.mark and token.endswith(self.mark) else token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text from scratch keeps the border between them."""
        rank, of_left, of_right, merge = self.rank, self.left, self.right, self.merge
        limit = len(merge)  # a merge over the border of lower rank would have come first
        while True:
            if merge.get(left << 32 | right, limit) < limit:
                return False
            a, b = rank[left], rank[right]
            # Undo the merge made last; of equal merges the left one is made first.
            if a > b:
                limit, left = a, of_right[left]
            elif b >= 0:
                limit, right = b + 1, of_left[right]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one prepared word."""
        text = word + _END if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.visible) + _END
        n = len(text)
        longest: list[int | None] = [None] * n
        for end, (before, i) in self.automaton.iter(text):  # by end: a later token at a start is longer
            longest[end - before] = i
        length, shorter, pairs = self.length, self.shorter, self.pairs
        ids: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while at < n:
            while token is not None:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    key = last << 32 | token
                    holds = pairs.get(key)
                    if holds is None:
                        holds = pairs[key] = self.compatible(last, token)
                    if holds:
                        break
                token = shorter[token]
            if token is not None:
                ids.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
                continue
            if not ids:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            dead.add(at)
            token = ids.pop()
            at -= length[token]
            token, last = shorter[token], ids[-1] if ids else -1
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special tokens in it included."""
        packed: list[bytes] = []
        for piece in self.pieces(text):
            if piece in self.special:
                packed.append(self.id_type(self.special[piece]).tobytes())
            elif _SEPARATORS.search(piece):  # white space to Python, but not to the vocabulary
                packed += map(self.known.__getitem__, self.words(piece))
            else:
                packed += map(self.chunks.__getitem__, piece.split())
        self.known.trim()
        self.chunks.trim()
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        return np.frombuffer(b"".join(packed), self.id_type)

    def packed_word(self, word: str) -> bytes:
        return array(self.id_code, self.encode_word(word)).tobytes()

    def packed_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words(chunk)))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token strings, joined by a space."""
        return self.strings.joined(ids)


class _Strings:
    """Strings, each with the space after it, one behind the other, and their offsets."""

    def __init__(self, strings: list[str]):
        parts = [s.encode() + b" " for s in strings]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        source = np.repeat(self.start[ids] - (ends - size), size)
        source += np.arange(len(source))
        return self.bytes[source[:-1]].tobytes()


class _Kept(dict):
    """Packed ids of words, or of what stands between white space, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        packed = self.make(text)
        if len(text) <= 64:
            self[text] = packed
        return packed

    def trim(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()


_LOADED: dict[tuple, Prepared] = {}


def loaded(definition: str, kind: type[Prepared] = Vocabulary) -> Prepared:
    """The worker's vocabulary, built once."""
    key = kind, hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(definition)
        gc.freeze()  # the tables stay: collections need not look through them
    return _LOADED[key]


def read_definition(path: str) -> str:
    """The vocabulary file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, decoded text."""

    def row(vocabulary: Vocabulary, ids: np.ndarray) -> tuple:
        return ids.tolist(), vocabulary.decode(ids).decode()

    return _mapped(df, path, id_col, text_col, row, {"ids": pa.list_(pa.int32()), "decoded": pa.string()}, "ids array<int>, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def row(vocabulary: Vocabulary, ids: np.ndarray) -> tuple:
        listed, decoded = vocabulary.digits.joined(ids), vocabulary.decode(ids)
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(df, path, id_col, text_col, row, types, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(df: DataFrame, path: str, id_col: str, text_col: str, row, types: dict, schema: str) -> DataFrame:
    common.on_workers(df.sparkSession)
    definition = df.sparkSession.sparkContext.broadcast(read_definition(path))
    fields = pa.schema([("doc_id", pa.int64()), *types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(definition.value)
        for batch in batches:
            rows = [row(vocabulary, vocabulary.encode(text.as_py())) for text in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=fields)

    return common.id_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, {schema}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(common.table(spark, sf_dir, "documents"), tokenizer_path())
