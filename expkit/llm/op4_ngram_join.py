"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Texts in lower case, with white space runs as single spaces, are sets of five-word
n-grams (64-bit hashes; a shorter text is one n-gram).  Equal texts collapse to
one representative, so groups of copies never meet pair by pair.  The number of
bands follows from the rows per band, the threshold and the target recall:
``bands(0.8, 8, 0.999)`` is 38.

1.  Signatures are computed where documents are read; only band hashes travel.
2.  Representatives that share a band hash are linked to the smallest of them (a
    star per bucket, linear in its size).  Components of these links hold every
    candidate pair.
3.  A component of up to ``CELL`` members is one cell: its texts come together
    once, and all its pairs that share a band are verified.  In a larger component, each band
    bucket is dealt into cells by itself, and a bucket of more than ``CELL``
    members into pairs of blocks; a pair of texts counts in the first band that
    it shares, so no link counts twice.  Cells report a number of links per
    member and a spanning forest of its links, never the pairs.  Cells are packed
    into bins of about ``BIN`` rows, whatever the input's size.
4.  Components of the verified links are the classes.

One rule holds at every size: a link is a pair that shares a band and reaches the
threshold.  A pair at the threshold shares none with a probability of at most one
less the recall (0.001).

Defined results: one row per input row: doc_id, rep_id (smallest id with the same
text), class_id (smallest id of the class), n_links (number of other texts with
similarity at or over the threshold), kept (doc_id is class_id, and the text is the
class's text under that id: of several, the one with the least hashes), and the text's
hashes h1 and h2.  Null text
counts as empty; empty texts are copies of each other and link to no other text;
rows with a null id come out as a class of their own with null ids and no links;
repeated rows come out repeated; an id on rows with different texts stands for
each of them, and every text has links of its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, THRESHOLD = 5, 0.8
BAND_ROWS, RECALL = 8, 0.999
#: Members of a block, and rows of a bin of cells.
CELL, BIN = 512, 1024
#: Copies of a large component's row that its members are spread over.
SPREAD = 16
WORDS_KEPT = 800_000


def bands(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` rows that find a pair at the threshold with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        raw = word.encode()
        value = self[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)
        return value


def ngrams(text: str, hashes: dict, n: int = WORDS) -> np.ndarray:
    """The distinct n-gram hashes of a normalised text, sorted."""
    words = text.split(" ") if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_11)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_hashes(grams: np.ndarray, multiply: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of the set's MinHash signature."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multiply), np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 4096):
        np.minimum(low, (multiply[:, None] * x[None, at : at + 4096] + add[:, None]).min(axis=1), out=low)
    h = np.zeros(len(low) // rows, np.uint64)
    for column in low.reshape(-1, rows).T:
        h = (h ^ column) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the similarity; nothing is linked to itself."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    gram, column, found = np.unique(np.concatenate(sets) if n else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    shared = found > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n))
    width = 4096
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        held = np.zeros((n, width), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        both += held @ held.T
    union = size[:, None] + size[None, :] - both
    link = (both >= threshold * union - 1e-9) & (both > 0)
    np.fill_diagonal(link, False)
    return link


def forest(link: np.ndarray) -> np.ndarray:
    """For each row, the first row of its component."""
    root = np.arange(len(link))
    while True:
        lower = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link)))
        lower = np.minimum(lower, lower[lower])
        if (lower == root).all():
            return root
        root = lower


def normal(text: Column) -> Column:
    """The text in lower case, with single spaces for white space."""
    return F.lower(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that stay: one of each class.

    That is the row of the class's smallest id; where this id stands on several texts of the class, the one with
    the least hashes; of rows alike in id and normalised text, one.  Rows with a null id are each their own class.
    """
    kept = jaccard_classes(df, id_col=id_col, text_col=text_col, **options).where("kept and doc_id is not null").select(
        F.col("doc_id").alias("kept_id"), F.col("h1").alias("kept_h1"), F.col("h2").alias("kept_h2"))
    numbered, (doc_id, text) = common.picked(df, id_col, text_col)
    norm = normal(F.coalesce(text.cast("string"), F.lit("")))
    keyed = numbered.withColumns({"key": doc_id.cast("long"), "h1": F.xxhash64(norm), "h2": F.xxhash64(F.lit(1), norm)})
    same = (F.col("key") == F.col("kept_id")) & (F.col("h1") == F.col("kept_h1")) & (F.col("h2") == F.col("kept_h2"))
    rows = keyed.join(kept, same, "left_semi").dropDuplicates(["key", "h1", "h2"]).select(*numbered.columns)
    return rows.unionAll(numbered.where(doc_id.cast("long").isNull())).toDF(*df.columns)


def jaccard_classes(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, band_rows: int = BAND_ROWS, recall: float = RECALL,
                    cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, rep_id, class_id, n_links, kept, h1, h2."""
    common.on_workers(df.sparkSession)
    n_bands = bands(threshold, band_rows, recall)
    multiply, add = _seeds(n_bands * band_rows)
    docs = common.id_text(df, id_col, text_col).select("doc_id", normal(F.col("text")).alias("norm"))
    docs = docs.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(1), "norm")})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            signed = []
            for text in batch["norm"]:
                grams = ngrams(text.as_py(), hashes, words)
                signed.append(band_hashes(grams, multiply, add, band_rows) if len(grams) else [])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "h1": batch["h1"], "h2": batch["h2"], "bands": pa.array(signed, pa.list_(pa.int64()))})

    signed = common.cut_lineage(docs.mapInArrow(common.tidied(sign), "doc_id long, h1 long, h2 long, bands array<bigint>"))
    reps = signed.where("doc_id is not null").groupBy("h1", "h2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep_id"))
    # A number per text: an id may stand on rows with different texts.
    reps = common.cut_lineage(reps.withColumn("rep", F.monotonically_increasing_id()))

    # Every bucket's members and size, dealt once by bucket.
    in_bucket = reps.select("rep", F.posexplode("bands").alias("band", "bucket")).repartition("band", "bucket")
    buckets = in_bucket.groupBy("band", "bucket").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = common.cut_lineage(in_bucket.join(buckets.hint("shuffle_hash"), ["band", "bucket"]).select("rep", "band", "bucket", "first", "n"))
    candidates = components(members.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    # Only roots of large components are looked up, each in as many copies as its members are spread over.
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > cell)
    sizes = sizes.select(F.col("root").alias("large_root"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("copy"))
    spread = candidates.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
    placed = spread.join(sizes, (F.col("root") == F.col("large_root")) & (F.col("spread") == F.col("copy")), "left")
    placed = common.cut_lineage(placed.select(F.col("id").alias("rep"), "root", F.col("large_root").isNotNull().alias("large")))

    # Cells: (rep, band, key, i, j, block); band -1 for whole components.
    small = placed.where(~F.col("large")).select(
        "rep", F.lit(-1).alias("band"), F.col("root").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
    blocks = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    in_large = members.join(placed.where("large").select("rep"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    large = in_large.select("rep", "band", F.col("bucket").alias("key"), "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "rep", "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    cells = common.cut_lineage(small.unionByName(large))
    n_bins = max(1, math.ceil(cells.count() / BIN))
    cells = cells.withColumn("bin", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(n_bins)))

    wanted = reps.join(placed.select("rep"), "rep", "left_semi").select(F.col("rep_id").alias("doc_id"), "h1", "h2", F.col("rep").alias("of"), "bands")
    texts = docs.join(wanted, ["doc_id", "h1", "h2"]).select("of", "norm", "bands").dropDuplicates(["of"])
    shipped = cells.join(texts, cells["rep"] == texts["of"]).select("rep", "band", "key", "i", "j", "block", "bin", "norm", "bands")

    def verify(bin_rows: pa.Table) -> pa.Table:
        hashes = _WordHashes()
        bin_rows = bin_rows.sort_by([("band", "ascending"), ("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        band, key, i, j, block, rep = (bin_rows[c].to_numpy() for c in ("band", "key", "i", "j", "block", "rep"))
        change = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        out: dict[str, list] = {"rep": [], "root": [], "links": []}
        for a, b in zip(change[:-1], change[1:], strict=True):
            if b - a < 2:
                continue
            some = bin_rows.slice(a, b - a)
            link = linked([ngrams(t.as_py(), hashes, words) for t in some["norm"]], threshold)
            signature = some["bands"].combine_chunks().flatten().to_numpy().reshape(b - a, -1)
            if band[a] < 0:
                one, other = np.nonzero(link)
                link[one, other] = (signature[one] == signature[other]).any(axis=1)
            else:
                for earlier in signature[:, : band[a]].T:
                    link &= earlier[:, None] != earlier[None, :]
                if i[a] != j[a]:
                    link &= block[a:b, None] != block[None, a:b]
            root = forest(link)
            count = link.sum(axis=1)
            use = np.flatnonzero(count)
            out["rep"].append(rep[a:b][use]), out["root"].append(rep[a:b][root[use]]), out["links"].append(count[use])
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in out.items()})

    verified = common.cut_lineage(shipped.groupBy("bin").applyInArrow(verify, "rep long, root long, links long"))
    links = verified.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    members = classes.join(reps.select(F.col("rep").alias("id"), "rep_id", "h1", "h2"), "id")
    names = members.groupBy("root").agg(F.min(F.struct("rep_id", "h1", "h2")).alias("class"))
    classes = members.select("id", "root").join(names, "root")
    found = links.join(classes, links["rep"] == classes["id"], "left").select("rep", "class", "n_links")
    of_text = reps.select("h1", "h2", "rep", "rep_id").join(found, "rep", "left").drop("rep").withColumnRenamed("rep_id", "rep")
    own_text = F.col("class").isNull() | ((F.col("class.h1") == F.col("h1")) & (F.col("class.h2") == F.col("h2")))
    return signed.select("doc_id", "h1", "h2").join(of_text, ["h1", "h2"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class.rep_id", "rep")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.coalesce((F.col("doc_id") == F.coalesce("class.rep_id", "rep")) & own_text, F.lit(True)).alias("kept"),
        "h1",
        "h2",
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and numbers of links of all documents."""
    return jaccard_classes(common.table(spark, sf_dir, "documents")).drop("h1", "h2")
