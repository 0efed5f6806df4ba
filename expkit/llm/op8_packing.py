"""Packing by lexical retrieval: windows of documents that share rare words.

Documents are encoded in their tasks and kept in the shared folder.  Numbers of
documents per term, the number of documents and their mean length come from all
of them, so a term weighs the same everywhere.  Documents are then placed by
content, at a cost per document that does not grow with the input: each gets the
best of at most ``CELLS`` centroids (fitted to about ``SAMPLE`` documents, a bound
that holds at every size; like centroids side by side) and, in a cell, its
weighted min-hash terms, the term that wins a race at the rate of its weight, and
the runner-up.  These make one sort key, whose last bits are dealt by id and
text, so copies can be parted (rows alike in both stay in one partition, which is
read in order, a shard at a time).  The key's ranges go to partitions, each is read in order,
and every ``shard_docs`` documents (up to twice as many at a range's end) are a
shard.  Each shard holds a BM25 inverted index over its documents' tails (what
full windows leave of a document), with token ids as terms.  A seed is asked
against its own shard only, so neighbours that were placed elsewhere are missed;
the README has the measured recall against a search of the whole corpus.  Documents are
seeds in the key's order: a seed's terms are all looked up, and unused neighbours
that fit are put behind it, best first, until the window is full or none fits.  Where more than ``slack`` ids
of room remain, the best neighbour left is cut, its rest going back to the pool.
Only when no unused document shares a term with the seed do the longest unused
tails that fit close the room, the longest left being cut likewise.  The closing
id is no term.  Only the last window of a shard can stay short.

Ids are those of the tokenizers library, which ``batch_ids`` asks once for each word that
a worker doesn't know; the vocabulary file is read on the driver and sent out once.

Defined results: a null or empty text is the closing id alone; a repeated row is
a document of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .batch_ids import BatchEncoder
from .op10_bpe import loaded, read_definition, tokenizer_path

SHARD_DOCS = 1024
#: Centroids, the documents they are fitted to (about; twice as many at most), documents a centroid at least, and rounds.
CELLS, SAMPLE, LEAST_FITTED, ROUNDS = 256, 8192, 32, 4
#: Shards a partition (about), partitions at most, and sampled keys a partition.
SHARDS_READ, MOST_PARTS, KEYS_READ = 4, 20_000, 64
#: Bits of the key for each min-hash term and for the deal of like documents.
TERM_BITS, DEAL_BITS = 20, 15
WINDOW = 2048
#: Room that may stay empty rather than cut a document for it.
SLACK = 24
#: Terms found in this share of a shard's documents have a row of weights for all of them.
DENSE = 1 / 16
#: Documents encoded or placed together.
TOGETHER = 1024
CLOSING_ID = 1
K1, B = 1.2, 0.75


class Corpus:
    """What BM25 needs to know of all documents: their number, mean length, and how many hold each term."""

    def __init__(self, n: int, mean: float, found: np.ndarray):
        self.n, self.mean, self.found = n, mean, found

    @staticmethod
    def counts(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and the number of tails that hold each."""
        found = np.bincount(_held(tails)[1])
        terms = np.flatnonzero(found)
        return terms, found[terms]

    def idf(self, terms: np.ndarray) -> np.ndarray:
        found = self.found[terms]
        return np.log(1 + (self.n - found + 0.5) / (found + 0.5))

    def norm(self, length: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * length / max(self.mean, 1))


def _held(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, term, count) of the terms of each tail, in this order."""
    if not sum(map(len, tails)):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    terms = np.concatenate(tails)
    narrow = terms.dtype.itemsize <= 2 and len(tails) <= 1 << 16
    kind, bits = (np.uint32, 16) if narrow else (np.int64, 32)
    key = np.repeat(np.arange(len(tails), dtype=kind) << kind(bits), [len(t) for t in tails])
    key |= terms.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    key = key[first].astype(np.int64)
    return key >> bits, key & ((1 << bits) - 1), count


class ShardIndex:
    """BM25 inverted index over the tails of a shard, weighted by the corpus (if not given: by the shard itself)."""

    def __init__(self, tails: list[np.ndarray], corpus: Corpus | None = None):
        n = len(tails)
        self.doc, term, count = _held(tails)
        length = np.array([len(t) for t in tails], float)
        order = np.argsort(term, kind="stable")
        term, self.doc, count = term[order], self.doc[order], count[order]
        self.terms, self.first, found = np.unique(term, return_index=True, return_counts=True)
        self.last = self.first + found
        if corpus is None:
            held = np.zeros(int(self.terms.max(initial=-1)) + 1, np.int64)
            held[self.terms] = found
            corpus = Corpus(n, float(length.mean()) if n else 0, held)
        idf, norm = corpus.idf(self.terms), corpus.norm(length)
        self.weight = np.repeat(idf, found) * count * (K1 + 1) / (count + norm[self.doc])
        # Each document's query: all its terms that another one holds.
        by_doc = np.argsort(self.doc, kind="stable")
        at = np.repeat(np.arange(len(self.terms)), found)[by_doc]
        bounds = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        shared = found[at] > 1
        self.query = [at[a:b][shared[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.n = n
        # Weights of frequent terms, a row each (others: -1), and the documents that their columns stand for.
        frequent = found >= max(2, DENSE * n)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        row = np.repeat(self.row, found)
        self.rows, self.columns = np.zeros((np.count_nonzero(frequent), n)), np.arange(n)
        self.rows[row[row >= 0], self.doc[row >= 0]] = self.weight[row >= 0]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share terms with the seed, best first; what was used stays so."""
        if not len(terms := self.query[seed]):
            return np.empty(0, np.int64)
        left = unused[self.columns]
        if 4 * np.count_nonzero(left) < 3 * len(left):
            self.rows, self.columns = np.ascontiguousarray(self.rows[:, left]), self.columns[left]
        rows, rare = self.row[terms], terms[self.row[terms] < 0]
        n = self.last[rare] - self.first[rare]
        at = np.repeat(self.last[rare] - np.cumsum(n), n)
        at += np.arange(len(at))
        score = np.bincount(self.doc[at], self.weight[at], minlength=self.n).astype(float)
        score[self.columns] += self.rows[rows[rows >= 0]].sum(axis=0)
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


class Cells:
    """Centroids of sampled tails, like ones side by side, and the sort key they give a tail."""

    def __init__(self, tails: list[np.ndarray], corpus: Corpus):
        self.idf, self.corpus = corpus.idf(np.arange(len(corpus.found))).astype(np.float32), corpus
        rng = np.random.default_rng(8)
        # Arrival of each term in two races at the rate of its weight; terms of one document only never meet.
        rate = np.where(corpus.found > 1, np.maximum(self.idf, 1e-6), 1e-12)
        self.races = [rng.exponential(size=len(rate)) / rate for _ in range(2)]
        tails = [t for t in tails if len(t)]
        used = np.unique(np.concatenate(tails)) if tails else np.empty(0, np.int64)
        # Row 0 is for terms that no sampled tail holds.
        self.row = np.zeros(len(corpus.found), np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        cells = min(CELLS, max(1, len(tails) // LEAST_FITTED))
        self.centroids = np.zeros((len(used) + 1, cells), np.float32)
        weighed = [w for at in range(0, len(tails), TOGETHER) for w in self._weighed(tails[at : at + TOGETHER])]
        for cell, (terms, weight) in enumerate(weighed[:cells]):
            self.centroids[self.row[terms], cell] = weight / np.linalg.norm(weight)
        for _ in range(ROUNDS if cells > 1 else 0):
            sums = np.zeros_like(self.centroids)
            for terms, weight in weighed:
                sums[self.row[terms], self._cell(terms, weight)] += weight / np.linalg.norm(weight)
            size = np.linalg.norm(sums, axis=0)
            sums /= np.where(size > 0, size, 1)
            self.centroids = np.where(size > 0, sums, self.centroids)
        self.centroids = np.ascontiguousarray(self.centroids[:, _chained(self.centroids.T @ self.centroids)])

    def _weighed(self, tails: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The terms of each tail and their BM25 weights."""
        tail, term, count = _held(tails)
        norm = self.corpus.norm(np.array([len(t) for t in tails], float))
        weight = self.idf[term] * (count * (K1 + 1) / (count + norm[tail])).astype(np.float32)
        bounds = np.searchsorted(tail, np.arange(len(tails) + 1))
        return [(term[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _cell(self, terms: np.ndarray, weight: np.ndarray) -> int:
        return int(np.argmax(weight @ self.centroids[self.row[terms]]))

    def keys(self, tails: list[np.ndarray], deals: list[int]) -> np.ndarray:
        """Of each tail: the cell, two min-hash terms, and bits of the deal; 0 and the deal without terms."""
        keys = np.zeros(len(tails), np.int64)
        for i, (terms, weight) in enumerate(self._weighed(tails)):
            if len(terms):
                first, second = (int(terms[np.argmin(race[terms])]) % (1 << TERM_BITS) for race in self.races)
                keys[i] = (self._cell(terms, weight) << TERM_BITS | first) << TERM_BITS | second
        return keys << DEAL_BITS | np.array(deals, np.int64) % (1 << DEAL_BITS)


def _chained(near: np.ndarray) -> list[int]:
    """All numbers, each beside the one it is nearest to of those left."""
    order, left = [0], np.ones(len(near), bool)
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, near[order[-1]], -1))))
        left[order[-1]] = False
    return order


def pack_shard(ids: list[np.ndarray], window: int, slack: int, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start = np.array([len(x) // window * window for x in ids], np.int64)
    left = np.array([len(x) for x in ids], np.int64) - start
    for i, full in enumerate(start):
        for at in range(0, int(full), window):
            pieces.append((i, at, window, sequence, 0))
            sequence += 1
    index = ShardIndex([x[s:-1] for x, s in zip(ids, start, strict=True)], corpus)
    unused = left > 0
    for seed in range(len(ids)):
        if not unused[seed]:
            continue
        room = window

        def put(i: int, length: int) -> None:
            nonlocal room
            pieces.append((i, int(start[i]), int(length), sequence, window - room))
            start[i] += length
            left[i] -= length
            unused[i] = left[i] > 0
            room -= int(length)

        put(seed, left[seed])
        near = index.neighbours(seed, unused)
        fit = near
        while room > 0 and len(fit := fit[left[fit] <= room]):
            put(fit[0], left[fit[0]])
            fit = fit[1:]
        near = near[unused[near]]
        if not len(near):
            while room > 0 and len(fit := np.flatnonzero(unused & (left <= room))):
                i = fit[np.argmax(left[fit])]
                put(i, left[i])
        if room > slack and unused.any():
            i = near[0] if len(near) else int(np.argmax(np.where(unused, left, 0)))
            put(i, min(room, left[i]))
        sequence += 1
    return pieces


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _read(column: pa.Array, width: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b.as_py(), f"<u{w.as_py()}") for b, w in zip(column, width, strict=True)]


def _corpus(tails: DataFrame) -> Corpus:
    """Whole-corpus figures; a row per term of the vocabulary comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, length = np.zeros(0, np.int64), 0, 0
        for batch in _slices(batches):
            some = _read(batch["tail"], batch["width"])
            terms, held = Corpus.counts(some)
            found = np.pad(found, (0, max(0, int(terms.max(initial=-1)) + 1 - len(found))))
            found[terms] += held
            n, length = n + len(some), length + sum(map(len, some))
        use = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *use.tolist()], pa.int64()), "n": pa.array([n, length, *found[use].tolist()], pa.int64())})

    rows = tails.mapInArrow(common.tidied(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by_term = {r.term: r.n for r in rows}
    n, length = by_term.pop(-2, 0), by_term.pop(-1, 0)
    found = np.zeros(max(by_term, default=-1) + 1, np.int64)
    found[list(by_term)] = list(by_term.values())
    return Corpus(n, length / max(n, 1), found)


def _placed(encoded: DataFrame, tails: DataFrame, corpus: Corpus, window: int, shard_docs: int) -> DataFrame:
    """The documents in partitions of like ones, sorted: part, key, deal, doc_id, width, ids."""
    spark, n = encoded.sparkSession, corpus.n
    sample = tails.where(F.pmod("deal", F.lit(max(1, n // SAMPLE))) == 0).where("length(tail) > 0").select("deal", "width", "tail").collect()
    sample.sort(key=lambda r: r.deal)
    unlike = list({bytes(r.tail): r.width for r in sample[: 2 * SAMPLE]}.items())
    cells = spark.sparkContext.broadcast(Cells([np.frombuffer(t, f"<u{w}") for t, w in unlike], corpus))

    parts = min(MOST_PARTS, max(1, math.ceil(n / (SHARDS_READ * shard_docs))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = cells.value.keys(_read(batch["tail"], batch["width"]), batch["deal"].to_pylist())
            yield pa.RecordBatch.from_pydict({"key": pa.array(found)})

    one_in = max(1, n // (KEYS_READ * parts))
    known = tails.where(F.pmod(F.shiftright("deal", 20), F.lit(one_in)) == 0).mapInArrow(common.tidied(keys), "key long") if parts > 1 else None
    read = np.sort([r.key for r in known.collect()]) if known is not None else np.empty(0, np.int64)
    bounds = read[np.arange(1, parts) * len(read) // parts] if len(read) else np.empty(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            tail = [x[len(x) // window * window : -1] for x in _read(batch["ids"], batch["width"])]
            key = cells.value.keys(tail, batch["deal"].to_pylist())
            part = np.searchsorted(bounds, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part), "key": pa.array(key), **{c: batch[c] for c in ("deal", "doc_id", "width", "ids")}})

    placed = encoded.mapInArrow(common.tidied(place), "part int, key long, deal long, doc_id long, width int, ids binary")
    return placed.repartitionById(parts, "part").sortWithinPartitions("part", "key", "deal")


def pack(df: DataFrame, path: str, window: int = WINDOW, slack: int = SLACK, shard_docs: int = SHARD_DOCS, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked)."""
    spark = df.sparkSession
    common.on_workers(spark)
    definition = spark.sparkContext.broadcast(read_definition(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(definition.value, BatchEncoder)
        closing = np.array([CLOSING_ID], encoder.id_type).tobytes()
        width = encoder.id_type().itemsize
        for batch in _slices(batches):
            packed = [ids.tobytes() + closing for ids in encoder.encode_all(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "width": pa.array([width] * len(packed), pa.int32()), "ids": pa.array(packed, pa.binary())})

    encoded = common.id_text(df, id_col, text_col).mapInArrow(common.tidied(encode), "doc_id long, width int, ids binary")
    encoded = common.stored(encoded, "packing-ids").withColumn("deal", F.xxhash64("doc_id", "ids"))
    # Without the closing id, which is no term.
    tails = encoded.select("width", "deal", F.expr(f"substring(ids, cast(length(ids) div (width * {window}) * (width * {window}) as int) + 1)").alias("tail"))
    tails = tails.withColumn("tail", F.expr("substring(tail, 1, greatest(length(tail) - width, 0))"))
    corpus = _corpus(tails)
    placed = _placed(encoded, tails, corpus, window, shard_docs)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    known = spark.sparkContext.broadcast(corpus)

    def packed(doc_id: list, ids: list[np.ndarray], shard: int) -> pa.RecordBatch:
        pieces = pack_shard(ids, window, slack, known.value)
        own = [ids[i][s : s + n].astype("<u4") for i, s, n, _, _ in pieces]
        columns = {
            "doc_id": pa.array([doc_id[p[0]] for p in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id: list = []
        ids: list[np.ndarray] = []
        part, shard = -1, 0
        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else part
            for at in range(0, batch.num_rows, shard_docs):
                some = batch.slice(at, shard_docs)
                doc_id += some["doc_id"].to_pylist()
                ids += _read(some["ids"], some["width"])
                if len(ids) >= 2 * shard_docs:
                    yield packed(doc_id[:shard_docs], ids[:shard_docs], (part << 16) + shard)
                    doc_id, ids, shard = doc_id[shard_docs:], ids[shard_docs:], shard + 1
        if ids:
            yield packed(doc_id, ids, (part << 16) + shard)

    return placed.mapInArrow(common.tidied(shards), schema + (", ids array<int>" if with_ids else ""))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())
