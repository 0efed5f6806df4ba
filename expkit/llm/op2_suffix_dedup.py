"""Removal of repeated passages by an enhanced suffix array, in anchor order.

All suffixes of a corpus cannot be sorted in one place, and need not be: two equal
strings of LENGTH bytes have the same anchor at the same place (the least-hashed
ANCHOR bytes within; see ``suffixes``), so suffixes that may match are those whose
windows share an anchor.

1.  Documents are dealt into batches of about ``BATCH_DOCS`` by id; this is the one
    shuffle of text, and all steps below read it.  Copies of a whole text (all but
    the smallest id) are known from text hashes: they lose all their bytes and
    take part no further, so groups of copies cost nothing.
2.  Each batch reports its distinct anchors, 4 bytes each, to the bucket of the
    anchor's hash; a bucket answers each batch with those that other documents hold.
3.  Batches send the segments around those anchors, each distinct segment once with
    the smallest and largest id that hold it.  For anchors found in a large share of
    the batches (the edges of a very common passage, with a different text after it
    each time), segments are cut into single windows that travel by their own hash,
    so that no bucket gathers them all.
4.  A bucket sorts the suffixes of the segments that share an anchor, takes common
    prefixes of neighbours and scans them with a stack for the intervals of the
    common-prefix tree; intervals with different bytes to their left are maximal
    repeats, with all their occurrences.  Each is answered to the batches in which
    an occurrence belongs to a larger id than the smallest one of the group.
5.  Batches mark what the groups cover and cut it out.

Numbers of batches and buckets grow with the input, their sizes do not.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing;
a row with a null id loses nothing and takes nothing from others; rows that share an
id do not take from each other; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, suffixes
from .suffixes import LENGTH, Segments

BATCH_DOCS, BUCKET_DOCS = 1024, 2048
#: Bits of an anchor that are compared within a bucket.
KEY_BITS = 31
#: An anchor is hot if it is in so many batches, and in this share of them.  One that is not brings its bucket
#: at most HOT_BATCHES * BATCH_DOCS segments of up to 80 bytes, and single windows take more room than segments.
HOT_BATCHES, HOT_SHARE = 1024, 1 / 16
_RECORD = np.dtype([("hash", "<u8"), ("first", "<u2"), ("length", "<u2"), ("least", "<i8")])
_SENT = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("least", "<i8"), ("most", "<i8"), ("size", "<u2")])


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class _Batch:
    """The texts of a batch that take part."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        self.ids = docs["doc_id"]
        bounds, data = _binary(docs["data"])
        self.texts = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        copies = notes.filter(pa.compute.equal(notes["bucket"], -1))
        whole = set(zip(copies["copy_id"].to_pylist(), copies["copy_hash"].to_pylist(), strict=True))
        ids = self.ids.to_pylist()
        self.copy = [k in whole for k in zip(ids, docs["h1"].to_pylist(), strict=True)]
        self.use = [i for i, (c, d) in enumerate(zip(self.copy, ids, strict=True)) if d is not None and not c]
        self.doc = np.array([ids[i] for i in self.use], np.int64)
        self.segments = Segments([self.texts[i] for i in self.use])
        self.bytes = np.concatenate([*(self.texts[i] for i in self.use), np.empty(0, np.uint8)])
        size = np.array([len(self.texts[i]) for i in self.use], np.int64)
        self.start = np.cumsum(size) - size
        # Segments by their place in the batch's bytes.
        s = self.segments
        self.at, self.size, self.anchor, self.hash = self.start[s.text] + s.first, s.size, s.anchor, s.hash
        self.owner = self.doc[s.text]

    def cut(self, hot: np.ndarray) -> None:
        """Replace the marked segments by their windows."""
        count = self.size[hot] - LENGTH + 1
        at = np.repeat(self.at[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = np.repeat(self.owner[hot], count)
        window = suffixes.window_hashes(self.bytes, at)
        keep = ~hot
        self.at, self.owner = np.r_[self.at[keep], at], np.r_[self.owner[keep], own]
        self.size = np.r_[self.size[keep], np.full(len(at), LENGTH)]
        self.anchor, self.hash = np.r_[self.anchor[keep], window], np.r_[self.hash[keep], window]


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    array = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    if not len(array):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return offsets, data


def _by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key starts in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)


def suffix_dedup(df: DataFrame, batch_docs: int = BATCH_DOCS, bucket_docs: int = BUCKET_DOCS, hot_batches: int = HOT_BATCHES,
                 with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked)."""
    common.on_workers(df.sparkSession)
    n = df.count()
    n_batches = max(1, math.ceil(n / batch_docs))
    bits = max(0, math.ceil(math.log2(max(1, n / bucket_docs))))
    hot_from = max(hot_batches, math.ceil(n_batches * HOT_SHARE))
    code_shift, bucket_shift = np.uint64(64 - bits - KEY_BITS), 64 - bits

    docs = common.id_text(df, id_col, text_col).select(
        "doc_id", F.col("text").cast("binary").alias("data"), F.xxhash64("text").alias("h1"),
        F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).alias("batch"))
    hashed = common.id_text(df, id_col, text_col).where("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    firsts = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = hashed.join(firsts, ["h1", "h2"]).where("doc_id > least").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).alias("batch"), F.lit(-1).cast("long").alias("bucket"),
        F.lit(None).cast("binary").alias("keys"), F.col("doc_id").alias("copy_id"), F.col("h1").alias("copy_hash")).distinct()
    note = "batch long, bucket long, keys binary, copy_id long, copy_hash long"

    def bucket_of(anchor: np.ndarray) -> np.ndarray:
        return (anchor >> np.uint64(bucket_shift)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)

    def report(key: tuple, d: pa.Table, notes: pa.Table) -> pa.Table:
        batch = _Batch(d, notes)
        code = batch.anchor >> code_shift
        order, first = _by(code)
        code, owner = code[order], batch.owner[order]
        out: dict[str, list] = {"batch": [], "bucket": [], "keys": []}
        if len(first):
            several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
            code = code[first]
            bucket = (code >> np.uint64(KEY_BITS)).astype(np.int64)
            keys = ((code & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(1) | several.astype(np.uint64)).astype("<u4")
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out["batch"].append(key[0].as_py()), out["bucket"].append(int(bucket[a])), out["keys"].append(_packed(keys[a:b]))
        return pa.table(out, pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]))

    def shared(bucket: pa.Table) -> pa.Table:
        reported = [np.frombuffer(k.as_py(), "<u4") for k in bucket["keys"]]
        every = np.concatenate(reported)
        order, first = _by(every >> 1)
        found = np.diff(np.r_[first, len(every)])
        wanted = (found > 1) | (np.maximum.reduceat((every & 1)[order], first) > 0)
        value, hot = (every >> 1)[order][first][wanted], (found >= hot_from)[wanted]
        out: dict[str, list] = {"batch": [], "bucket": [], "keys": []}
        for batch, number, keys in zip(bucket["batch"].to_pylist(), bucket["bucket"].to_pylist(), reported, strict=True):
            k = keys >> 1
            at = np.minimum(np.searchsorted(value, k), max(0, len(value) - 1))
            held = value[at] == k if len(value) else np.zeros(len(k), bool)
            if held.any():
                out["batch"].append(batch), out["bucket"].append(number)
                out["keys"].append(_packed((k[held] << 1 | hot[at[held]]).astype("<u4")))
        columns = [pa.array(out["batch"], pa.int64()), pa.array(out["bucket"], pa.int64()), pa.array(out["keys"], pa.binary())]
        empty = pa.nulls(len(out["batch"]), pa.int64())
        return pa.table([*columns, empty, empty], names=["batch", "bucket", "keys", "copy_id", "copy_hash"])

    def marked(batch: _Batch, notes: pa.Table) -> np.ndarray:
        """Which segments have an anchor that other documents hold; hot ones are cut."""
        codes = [np.empty(0, np.uint64)]
        for bucket, keys in zip(notes["bucket"].to_pylist(), notes["keys"].to_pylist(), strict=True):
            if bucket >= 0:
                codes.append(np.uint64(bucket) << np.uint64(KEY_BITS + 1) | np.frombuffer(keys, "<u4").astype(np.uint64))
        code = np.sort(np.concatenate(codes))
        if not len(code):
            return np.zeros(len(batch.at), bool)
        own = batch.anchor >> code_shift
        at = np.minimum(np.searchsorted(code >> np.uint64(1), own), len(code) - 1)
        held = code[at] >> np.uint64(1) == own
        hot = held & (code[at] & np.uint64(1) == 1)
        if hot.any():
            held = np.r_[held[~hot], np.ones(int((batch.size[hot] - LENGTH + 1).sum()), bool)]
            batch.cut(hot)
        return held

    def send(key: tuple, d: pa.Table, notes: pa.Table) -> pa.Table:
        batch = _Batch(d, notes)
        held = np.flatnonzero(marked(batch, notes))
        order, first = _by(batch.hash[held])
        held = held[order]
        out: dict[str, list] = {"bucket": [], "batch": [], "sent": [], "data": []}
        if len(first):
            own = batch.owner[held]
            sent = np.empty(len(first), _SENT)
            one = held[first]
            sent["anchor"], sent["hash"], sent["size"] = batch.anchor[one], batch.hash[one], batch.size[one]
            sent["least"], sent["most"] = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
            bucket = bucket_of(sent["anchor"])
            order, first = _by(bucket)
            cuts = np.r_[first, len(order)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = order[a:b]
                at, size = batch.at[one[some]], batch.size[one[some]]
                source = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out["bucket"].append(int(bucket[some[0]])), out["batch"].append(key[0].as_py())
                out["sent"].append(_packed(sent[some])), out["data"].append(_packed(batch.bytes[source]))
        return pa.table(out, pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("sent", pa.binary()), ("data", pa.binary())]))

    def grouped(bucket: pa.Table) -> pa.Table:
        sent = [np.frombuffer(s.as_py(), _SENT) for s in bucket["sent"]]
        batch = np.repeat(np.array(bucket["batch"].to_pylist(), np.int64), [len(s) for s in sent])
        sent = np.concatenate(sent)
        _, data = _binary(bucket["data"])
        size = sent["size"].astype(np.int64)
        start = np.cumsum(size) - size
        order = np.lexsort((sent["hash"], sent["anchor"]))
        s = sent[order]
        first = np.flatnonzero(np.r_[True, (s["hash"][1:] != s["hash"][:-1]) | (s["anchor"][1:] != s["anchor"][:-1])])
        distinct = np.empty(len(sent), np.int64)
        distinct[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(s)]))
        least = np.minimum.reduceat(s["least"], first)
        one = order[first]
        source = np.repeat(start[one] - (np.cumsum(size[one]) - size[one]), size[one]) + np.arange(size[one].sum())
        groups = suffixes.repeats(s["anchor"][first], size[one], data[source])

        counts = np.array([len(g[0]) for g in groups])
        segment, offset = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
        at = np.cumsum(counts) - counts
        smallest = np.repeat(np.minimum.reduceat(least[segment], at), counts)
        length = np.repeat(np.array([g[2] for g in groups]), counts)
        # Occurrences of each group, batch by batch.
        holders, begin = _by(distinct)
        n_holders = np.diff(np.r_[begin, len(holders)])
        times = n_holders[segment]
        held = holders[np.repeat(begin[segment] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        record = np.empty(len(held), _RECORD)
        record["hash"], record["first"] = sent["hash"][held], np.repeat(offset, times)
        record["length"], record["least"] = np.repeat(length, times), np.repeat(smallest, times)
        use = sent["most"][held] > record["least"]
        record, to = record[use], batch[held[use]]
        order, first = _by(to)
        cuts = np.r_[first, len(order)]
        parts = [(int(to[order[a]]), _packed(record[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        empty = pa.nulls(len(parts), pa.int64())
        return pa.table([pa.array([p[0] for p in parts], pa.int64()), pa.array([-2] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), empty, empty],
                        names=["batch", "bucket", "keys", "copy_id", "copy_hash"])

    def cut_out(d: pa.Table, notes: pa.Table) -> pa.Table:
        batch = _Batch(d, notes)
        marked(batch, notes)
        answers = notes.filter(pa.compute.equal(notes["bucket"], -2))
        record = np.concatenate([np.empty(0, _RECORD), *(np.frombuffer(k.as_py(), _RECORD) for k in answers["keys"])])
        record = record[np.argsort(record["hash"], kind="stable")]
        low, high = np.searchsorted(record["hash"], batch.hash, "left"), np.searchsorted(record["hash"], batch.hash, "right")
        times = high - low
        row = np.repeat(np.arange(len(times)), times)
        which = record[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        use = batch.owner[row] > which["least"]
        begin = batch.at[row[use]] + which["first"][use]
        n_bytes = len(batch.bytes)
        depth = np.bincount(begin, minlength=n_bytes + 1) - np.bincount(begin + which["length"][use], minlength=n_bytes + 1)
        gone = np.cumsum(depth[:n_bytes]) > 0
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        place = dict(zip(batch.use, batch.start.tolist(), strict=True))
        for i, text in enumerate(batch.texts):
            if i in place:
                lost = gone[place[i] : place[i] + len(text)]
            else:
                lost = np.full(len(text), batch.copy[i] and len(text) >= LENGTH)
            removed = int(lost.sum())
            kept = _packed(text[~lost]) if removed else _packed(text)
            out["n_bytes"].append(len(text)), out["n_removed"].append(removed)
            out["n_spans"].append(int((lost[1:] & ~lost[:-1]).sum() + lost[0]) if removed else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest()), out["kept"].append(kept if with_text else None)
        fields = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), **({"kept": pa.binary()} if with_text else {})}
        return pa.table([batch.ids, *(pa.array(out[c], t) for c, t in fields.items())], names=["doc_id", *fields])

    by_batch = docs.groupBy("batch")
    reported = by_batch.cogroup(copies.groupBy("batch")).applyInArrow(report, "batch long, bucket long, keys binary")
    answered = reported.groupBy("bucket").applyInArrow(shared, note)
    sent = by_batch.cogroup(copies.unionByName(answered).groupBy("batch")).applyInArrow(send, "bucket long, batch long, sent binary, data binary")
    found = sent.groupBy("bucket").applyInArrow(grouped, note)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by_batch.cogroup(copies.unionByName(answered).unionByName(found).groupBy("batch")).applyInArrow(cut_out, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that documents with smaller ids hold leave all documents."""
    return suffix_dedup(common.table(spark, sf_dir, "documents"))
