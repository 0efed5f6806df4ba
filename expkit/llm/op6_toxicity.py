"""Toxic spans by a linear-chain conditional random field, and document scores.

Tokens are what stands between white space.  Labels are given for documents, so
token labels are derived first: among words and word beginnings, those that are
all but absent from clean training documents are chosen greedily, each time the
one found in most toxic documents not covered yet; tokens of toxic documents that
bear a chosen one are labelled toxic, all others clean.  A two-state chain over
the whole text is then fitted to these labels: emissions from the
word, its beginnings and its end (hashed to ``SLOTS`` weights), and transitions
between the states, by gradient ascent on the conditional likelihood with
forward-backward expectations.  Segments of ``SEGMENT`` tokens are only how the
work is cut: each gets the forward and backward vectors of its neighbours.  A document's score is a logistic function of its
tokens' marginals (the largest, and their sum), fitted to the document labels.
Tokens with a marginal over one half are the offending ones, reported by offset.

The model is fitted in a task, on at most ``PER_CLASS`` labelled training
documents of each class, taken whole and in hash order; their ids are chosen
from the labels and hashes, so only their texts are moved.  It is a fixed number
of weights, passes the driver as bytes and is sent out once.  All documents are then scored where they are read.
Only the text enters a score.

Defined results: null text counts as empty; an empty text has the score of no
tokens; repeated rows come out repeated; a document with several labels is toxic
if one of them says so; null labels are none; without toxic and clean training
documents all scores are the share of toxic ones (0 without labels); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Training texts of a class, at most.
PER_CLASS = 1500
SEGMENT, SLOTS = 64, 1 << 18
THRESHOLD = 0.3
#: Scored words kept by a worker.
WORDS_KEPT = 800_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
_TOKEN = re.compile(r"\S+")


def normal(token: str) -> str:
    return token.lower().strip(_EDGES)


def features(word: str) -> list[str]:
    """The word, its beginnings and its end."""
    return ["w" + word, *(f"b{n}" + word[:n] for n in range(3, 7) if len(word) >= n), "e" + word[-3:], "d" if any(map(str.isdigit, word)) else "l"]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % SLOTS for f in features(word)]


def seed_features(docs: list[np.ndarray], n_toxic: int, n_features: int, length: np.ndarray) -> np.ndarray:
    """Features (each document: its distinct ones) that cover the toxic documents and are all but absent from the others."""
    n_clean = len(docs) - n_toxic

    def found(some: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([*some, np.empty(0, np.int64)]), minlength=n_features)

    in_toxic, in_clean = found(docs[:n_toxic]), found(docs[n_toxic:])
    # What chance would cover grows more slowly than the sample.
    least = round(2 + math.sqrt(n_toxic) / 6) if n_toxic >= 30 else 2
    usable = (in_toxic >= least) & (in_clean <= 0.02 * max(1, n_clean) / max(1, n_toxic) * in_toxic)
    bearers: dict[int, set[int]] = {}
    for i, d in enumerate(docs[:n_toxic]):
        for f in d[usable[d]].tolist():
            bearers.setdefault(f, set()).add(i)
    chosen, uncovered = [], set(range(n_toxic))
    while bearers:
        f = max(bearers, key=lambda f: (len(bearers[f] & uncovered), -in_clean[f], length[f], -f))
        if len(bearers[f] & uncovered) < least:
            break
        chosen.append(f)
        uncovered -= bearers.pop(f)
    return np.array(chosen, np.int64)


def _neighbours(psi: np.ndarray, mask: np.ndarray, start: float, t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment: the forward vector of its first token and the backward vector of its last, given its whole text.

    The transfer matrix of a segment takes a vector from its first token to its last; so a text's segments
    need one step each to hand their vectors on, and segments of many texts are worked on together.
    """
    n, s = psi.shape
    m = np.zeros((2, 2, s))
    m[0, 0] = m[1, 1] = 1
    for i in range(1, n):
        on = mask[:, i]
        off, to = m[:, 0] * t[0, 0] + m[:, 1] * t[1, 0], (m[:, 0] * t[0, 1] + m[:, 1] * t[1, 1]) * psi[i]
        z = off.sum(axis=0) + to.sum(axis=0)
        m[:, 0], m[:, 1] = np.where(on, off / z, m[:, 0]), np.where(on, to / z, m[:, 1])
    place = np.arange(s) - np.maximum.accumulate(np.where(first, np.arange(s), 0))
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(place.max(initial=0) + 2))
    enter, leave = np.ones((2, s)), np.ones((2, s))
    enter[1] = np.exp(start) * psi[0]
    for k in range(1, len(cuts) - 1):
        at = by_place[cuts[k] : cuts[k + 1]]
        e0, e1 = (enter[0, at - 1] * m[0, j, at - 1] + enter[1, at - 1] * m[1, j, at - 1] for j in (0, 1))
        off, to = e0 * t[0, 0] + e1 * t[1, 0], (e0 * t[0, 1] + e1 * t[1, 1]) * psi[0, at]
        enter[0, at], enter[1, at] = off / (off + to), to / (off + to)
    for k in range(len(cuts) - 2, 0, -1):
        at = by_place[cuts[k] : cuts[k + 1]]
        b0, b1 = (m[j, 0, at] * leave[0, at] + m[j, 1, at] * leave[1, at] for j in (0, 1))
        b1 = b1 * psi[0, at]
        off, to = t[0, 0] * b0 + t[0, 1] * b1, t[1, 0] * b0 + t[1, 1] * b1
        leave[0, at - 1], leave[1, at - 1] = off / (off + to), to / (off + to)
    return enter, leave


def marginals(emission: np.ndarray, mask: np.ndarray, start: float, step: np.ndarray, expected: bool = False, first: np.ndarray | None = None):
    """Forward-backward over (segments, positions): toxic marginals, and if asked the expected transitions.

    ``first`` marks the segments that begin a text; the others go on with the one before.  Without it each begins one.
    """
    s, n = emission.shape
    psi = np.exp(np.clip(emission, -30, 30)).T.copy()
    t = np.exp(step)
    a, b = np.empty((n, 2, s)), np.ones((n, 2, s))
    (a0, a1), last = (np.ones(s), np.exp(start) * psi[0]), None
    if first is not None and not first.all():
        (a0, a1), last = _neighbours(psi, mask, start, t, first)
        b[n - 1] = last
    for i in range(n):
        if i:
            a0, a1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * psi[i]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        a[i, 0], a[i, 1] = a0, a1
    for i in range(n - 2, -1, -1):
        on, after = mask[:, i + 1], b[i + 1, 1] * psi[i + 1]
        b0, b1 = t[0, 0] * b[i + 1, 0] + t[0, 1] * after, t[1, 0] * b[i + 1, 0] + t[1, 1] * after
        z = b0 + b1
        b[i, 0], b[i, 1] = np.where(on, b0 / z, 1.0), np.where(on, b1 / z, 1.0)
    toxic = a[:, 1] * b[:, 1]
    p = (toxic / (toxic + a[:, 0] * b[:, 0])).T
    if not expected:
        return p
    counts = np.zeros((2, 2))

    def crossed(before: np.ndarray, after_off: np.ndarray, after_on: np.ndarray) -> np.ndarray:
        both = np.array([[before[0] * t[0, 0] * after_off, before[0] * t[0, 1] * after_on], [before[1] * t[1, 0] * after_off, before[1] * t[1, 1] * after_on]])
        return (both / both.sum(axis=(0, 1))).sum(axis=2)

    for i in range(1, n):
        on = mask[:, i]
        counts += crossed(a[i - 1][:, on], b[i, 0, on], (psi[i] * b[i, 1])[on])
    if last is not None:
        at = np.flatnonzero(~first)
        counts += crossed(a[n - 1][:, at - 1], b[0, 0, at], psi[0, at] * b[0, 1, at])
    return p, counts


def segments(values: list[np.ndarray], fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' token values cut into rows of SEGMENT: (rows, mask, document of each row)."""
    doc = np.repeat(np.arange(len(values)), [-(-len(v) // SEGMENT) for v in values])
    rows = np.full((len(doc), SEGMENT), fill, values[0].dtype if values else float)
    mask = np.zeros(rows.shape, bool)
    at = 0
    for v in values:
        k = -(-len(v) // SEGMENT)
        rows[at : at + k].reshape(-1)[: len(v)] = v
        mask[at : at + k].reshape(-1)[: len(v)] = True
        at += k
    return rows, mask, doc


class Model:
    """Weights of the chain and of the document score."""

    def __init__(self, share: float):
        self.share = share
        self.weights: np.ndarray | None = None

    def fit(self, toxic: list[str], clean: list[str], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Model:
        vocabulary: dict[str, int] = {}
        index = [np.array([vocabulary.setdefault(normal(t), len(vocabulary)) for t in x.split()], np.int64) for x in [*toxic, *clean]]
        # Words and their beginnings, as numbers, word by word.
        numbers: dict[str, int] = {}
        of_word = [np.array([numbers.setdefault(f, len(numbers)) for f in features(w) if len(f) > 3 and f[0] in "wb"], np.int64) for w in vocabulary]
        sets = [np.unique(np.concatenate([*(of_word[w] for w in np.unique(ix)), np.empty(0, np.int64)])) for ix in index]
        seeds = seed_features(sets, len(toxic), len(numbers), np.array([len(f) for f in numbers]))
        seeds = np.isin(np.arange(len(numbers)), seeds)
        offends = np.array([bool(seeds[w].any()) for w in of_word], bool)
        labels = [offends[ix] if i < len(toxic) else np.zeros(len(ix), bool) for i, ix in enumerate(index)]
        del sets, numbers

        rows, mask, doc = segments([ix for ix in index if len(ix)] or [np.zeros(0, np.int64)], 0)
        y, _, _ = segments([lb for lb in labels if len(lb)] or [np.zeros(0, bool)], False)
        first = np.diff(doc, prepend=-1) != 0
        of_word = [slots(w) for w in vocabulary]
        slot = np.concatenate([np.array(s, np.int64) for s in of_word])
        word = np.repeat(np.arange(len(of_word)), [len(s) for s in of_word])

        w, start, step = np.zeros(SLOTS), -3.0, np.array([[0.0, -3.0], [0.0, 0.0]])
        bias, square, total = -2.0, np.full(SLOTS, 1e-6), max(1, int(mask.sum()))
        squares = np.full(6, 1e-6)
        # Transitions within a segment, and from one to the next of its text.
        before = np.concatenate([y[:, :-1][mask[:, 1:]], y[np.flatnonzero(~first) - 1, -1]])
        after = np.concatenate([y[:, 1:][mask[:, 1:]], y[~first, 0]])
        seen = np.bincount(2 * before + after, minlength=4).reshape(2, 2)
        for _ in range(rounds if y.any() else 0):
            emission = np.bincount(word, w[slot], minlength=len(vocabulary)) + bias
            p, moved = marginals(emission[rows], mask, start, step, expected=True, first=first)
            miss = np.where(mask, y - p, 0.0)
            by_word = np.bincount(rows.ravel(), miss.ravel(), minlength=len(vocabulary))
            up = np.bincount(slot, by_word[word], minlength=SLOTS) - decay * w
            square += up * up
            w += rate * up / np.sqrt(square)
            rest = np.array([miss.sum(), miss[first, 0].sum(), *(seen - moved).ravel()])
            squares += rest * rest
            move = rate * rest / np.sqrt(squares)
            bias, start = bias + move[0], start + move[1]
            step = step + move[2:].reshape(2, 2)
            if np.abs(miss).sum() < 1e-4 * total:
                break
        self.weights, self.bias, self.start, self.step = w.astype(np.float32), bias, start, step
        self.calibrate(toxic, clean)
        return self

    def calibrate(self, toxic: list[str], clean: list[str]) -> None:
        """Fit the document score by Newton steps; clean documents count by their share."""
        texts, known = [*toxic, *clean], _Known(self)
        each = [self.summaries(texts[i : i + 128], known)[0] for i in range(0, len(texts), 128)]
        x = np.column_stack([np.ones(len(texts)), np.concatenate(each)])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
        c = np.zeros(x.shape[1])
        weight = np.where(y == 1, self.share / max(1, len(toxic)), (1 - self.share) / max(1, len(clean))) * len(y)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
            c = c + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * c), -2, 2)
        self.document = c

    def emission(self, token: str) -> float:
        return float(self.weights[slots(normal(token))].sum() + self.bias)

    def summaries(self, texts: list[str], known: dict | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text: (log odds of the largest marginal, log of the sum); and the marginals."""
        known = _Known(self) if known is None else known
        values = [np.array(list(map(known.__getitem__, x.split())), np.float32) for x in texts]
        rows, mask, doc = segments(values, 0.0)
        top, total = np.full(len(texts), 1e-6), np.full(len(texts), 1e-6)
        p = np.zeros(rows.shape)
        if len(rows):
            p = np.where(mask, marginals(rows, mask, self.start, self.step, first=np.diff(doc, prepend=-1) != 0), 0.0)
            np.maximum.at(top, doc, p.max(axis=1))
            np.add.at(total, doc, p.sum(axis=1))
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        each = [p[first[i] : first[i + 1]].reshape(-1)[: len(v)] for i, v in enumerate(values)]
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.column_stack([np.log(top / (1 - top)), np.log(total)]), each

    def scored(self, texts: list[str], known: dict | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.weights is None:
            return np.full(len(texts), self.share), [np.zeros(0)] * len(texts)
        x, each = self.summaries(texts, known)
        return 1 / (1 + np.exp(-np.clip(self.document[0] + x @ self.document[1:], -30, 30))), each


class _Known(dict):
    """Emissions of tokens seen before."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[token] = self.model.emission(token)
        return value


def offsets(text: str, toxic: np.ndarray) -> list[dict]:
    """(start, end) in code points of the tokens with a marginal over one half."""
    if not (toxic > 0.5).any():
        return []
    return [{"start": m.start(), "end": m.end()} for m, p in zip(_TOKEN.finditer(text), toxic, strict=True) if p > 0.5]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_texts(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """((toxic, text), share): at most ``per_class`` different labelled training texts of each class, and the share of toxic documents."""
    marks = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("label_id")))
    marks = marks.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    share = marks.agg(F.avg("toxic")).first()[0] or 0.0
    texts = common.id_text(docs, id_col, text_col).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    # Equal texts count once, as toxic if one of them is marked so; only ids and hashes are shuffled.
    distinct = texts.select("doc_id", "h1", "h2").join(marks, F.col("doc_id") == F.col("label_id")).groupBy("h1", "h2").agg(
        F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("label_id").alias("at"), "label_id")).alias("first"))
    distinct = distinct.select("toxic", "first", F.col("first.label_id").alias("label_id"), F.col("h1").alias("label_h1"), F.col("h2").alias("label_h2"))
    chosen = [distinct.where(F.col("toxic") == c).orderBy("first", "label_h1", "label_h2").limit(per_class) for c in (1, 0)]
    same = (F.col("doc_id") == F.col("label_id")) & (F.col("h1") == F.col("label_h1")) & (F.col("h2") == F.col("label_h2"))
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), same)
    return sample.select("toxic", "text").dropDuplicates(["text"]), float(share)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted to the training texts, in one task."""
    texts, share = training_texts(docs, labels, per_class, id_col, text_col)
    common.on_workers(docs.sparkSession)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(text, toxic) for batch in batches for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True)})
        toxic, clean = [x for x, t in rows if t == 1], [x for x, t in rows if t == 0]
        model = Model(share)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model.fit(toxic, clean) if toxic and clean else model)], pa.binary())})

    # A bounded number of texts in one task: the driver sees the weights only.
    made = texts.repartition(1).mapInArrow(common.tidied(fitted), "model binary").collect()
    return pickle.loads(made[0].model) if made else Model(share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, offending offsets."""
    spark = docs.sparkSession
    common.on_workers(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some["text"].to_pylist()
                scores, each = sent.value.scored(texts, known)
                spans = [offsets(x, p) for x, p in zip(texts, each, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some["doc_id"],
                    "score": pa.array(scores, pa.float64()),
                    "predicted": pa.array((scores >= THRESHOLD).astype(np.int32)),
                    "offsets": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                })

    return common.id_text(docs, id_col, text_col).mapInArrow(common.tidied(run), "doc_id long, score double, predicted int, offsets array<struct<start:int,end:int>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    common.on_workers(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(sent.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                scores, _ = sent.value.scored([x or "" for x in some.column(at).to_pylist()], known)
                yield some.filter(pa.array(scores < threshold))

    numbered, _ = common.picked(docs)
    return numbered.mapInArrow(common.tidied(run), numbered.schema).toDF(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offsets")
