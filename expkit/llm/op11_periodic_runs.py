"""Periodic runs of words: stretches that repeat one passage at least ``least_exponent`` times.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and length >= max(least_length, least_exponent * q) that no neighbouring
word extends keeping period q.

Words of all texts of a batch become numbers in one array, with a number of its own
between two texts, so that nothing reaches across and everything below runs over
whole arrays.

Short periods are read off directly: for each lag up to ``DIRECT`` the places where
words that far apart agree are listed, and long enough stretches of such places are
runs.

Longer periods go by scales; the scale of s serves periods from s up to 2s.  With
t = s // 4, every stretch of t words gets a hash (made by doubling from the scale
before), except stretches that lie in a run with a period of at most t // 4, which
smaller scales have found.  The leftmost least hash of every t consecutive places is
a minimizer.  Inside a run of period q the minimizers repeat at distance q, because
equal surroundings choose equal places, and at least three in a row fit into four
periods; and some stretch is left to choose, because if all of them had a short
period, so had the run.  So pairs of equal minimizers that lie q apart, with a third
one q further, are the seeds of the scale; each is extended over agreeing words to
both sides.  Equal stretches that are left lie more than t // 4 apart, which bounds
the partners of a minimizer, whatever the text repeats.

Two stretches with one extent are the same run, whose period is the smaller one: a
stretch of four periods whose smallest period is less has a period that divides the
larger (Fine and Wilf).

The work is linear in the words, times a constant for the direct lags and one for
each scale; a text is a row, and rows of one batch are handled some
``WORDS_AT_ONCE`` at a time.  Nothing is shuffled.

Defined results: a null text counts as empty; no words, no runs and an empty
collapsed text; rows are handled each for itself, so repeated rows give repeated
results; a null id stays null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Periods up to here are read off directly; a power of two, so that it starts the first scale.
DIRECT = 32
#: Words of short texts that are handled together.
WORDS_AT_ONCE = 1 << 19
#: What the search itself finds; longer and more frequent repetition is picked from that.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
WHITE = r"[\x20\x09-\x0D]+"

_NO_RUNS = np.empty((0, 3), np.int64)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The low bits, which hold places; an Arrow batch has fewer words than that.
_PLACE = np.uint64((1 << 28) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers: shift-xor and multiply, twice."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the maximal stretches of consecutive numbers in an ascending list."""
    breaks = np.flatnonzero(np.diff(places) != 1)
    return places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]]


def _direct(words: np.ndarray, most: int) -> np.ndarray:
    """(start, length, period) of all stretches with a period up to ``most``, from one comparison a lag."""
    found = [_NO_RUNS]
    for q in range(1, min(most, len(words) // 2) + 1):
        places = np.flatnonzero(words[q:] == words[:-q])
        needed = max(LEAST_LENGTH, LEAST_EXPONENT * q) - q
        if len(places) < needed:
            continue
        first, last = _stretches(places)
        long = last - first + 1 >= needed
        if long.any():
            found.append(np.column_stack([first[long], last[long] - first[long] + 1 + q, np.full(long.sum(), q)]))
    return np.concatenate(found)


def _agreeing(words: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of agreeing words from places a < b on, to the right (step 1) or from them on to the left (step -1)."""
    n, done, block = len(words), 0, 64
    while True:
        if step > 0:
            size = min(block, n - b - done)
            same = words[a + done : a + done + size] == words[b + done : b + done + size]
        else:
            size = min(block, a + 1 - done)
            same = (words[a + 1 - done - size : a + 1 - done] == words[b + 1 - done - size : b + 1 - done])[::-1]
        if size <= 0:
            return done
        if not same.all():
            return done + int(same.argmin())
        done += size
        block *= 2


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Stretches around seeds (place, lag), each found once."""
    order = np.lexsort((at, lag))
    found, end, of = [], -1, -1
    for x, d in zip(at[order].tolist(), lag[order].tolist(), strict=True):
        if d == of and x < end:
            continue  # inside the stretch before
        left, right = _agreeing(words, x - 1, x + d - 1, -1) if x else 0, _agreeing(words, x, x + d, 1)
        of, end = d, x + right
        if left + right + d >= max(LEAST_LENGTH, LEAST_EXPONENT * d):
            found.append((x - left, left + right + d, d))
    return np.array(found, np.int64).reshape(-1, 3)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, the leftmost place of the least value among it and the next ``width`` - 1 (fewer at the end).

    The place stands in the low bits of what is compared, so it comes out with the least value and decides
    between equal ones; values agree where their high 36 bits do.
    """
    n = len(values)
    padded = np.full(-(-n // width) * width + width, _MOST)
    padded[:n] = (values & ~_PLACE) | np.arange(n, dtype=np.uint64)
    # Blocks of the width: a window is the tail of one block and the head of the next.
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[width - 1 : n + width - 1]) & _PLACE).astype(np.int64)


def _seeds(hashes: np.ndarray, t: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal minimizers s <= lag < 2s apart that are followed by a third at the same lag."""
    n = len(hashes)
    chosen = np.zeros(n, bool)
    chosen[_window_least(hashes, t)] = True
    chosen &= hashes != _MOST
    places = np.flatnonzero(chosen)
    order = np.argsort(hashes[places], kind="stable")
    p = places[order]
    h = hashes[p]
    at, lags = [], []
    for offset in range(1, len(p)):
        same = h[offset:] == h[:-offset]
        d = p[offset:] - p[:-offset]
        near = same & (d < 2 * s)
        if not near.any():
            break
        seed = np.flatnonzero(near & (d >= s))
        x, d = p[seed], d[seed]
        third = x + 2 * d
        inside = third < n
        x, d, third = x[inside], d[inside], third[inside]
        good = chosen[third] & (hashes[third] == hashes[x])
        at.append(x[good]), lags.append(d[good])
    return (np.concatenate(at), np.concatenate(lags)) if at else (np.empty(0, np.int64),) * 2


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Of stretches with one extent the one with the smallest period, in order of start and period."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(words: np.ndarray, sizes: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, direct: int = DIRECT) -> np.ndarray:
    """(start, length, period) of all runs of several texts, whose numbered words (>= 0) stand in one array.

    ``sizes`` are the texts' numbers of words; a run's start counts from the beginning of the array.
    """
    if least_length < LEAST_LENGTH or least_exponent < LEAST_EXPONENT or direct < 32 or direct & (direct - 1):
        raise ValueError("runs have at least 6 words and 4 periods, and direct lags end at a power of two from 32 on")
    gaps = np.arange(len(sizes))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    # One number of its own after each text.
    spaced = np.insert(words.astype(np.int64), begins[1:], -1 - gaps)
    starts = begins[:-1] + gaps
    runs = _direct(spaced, direct)

    s, t = direct, 1
    live = np.flatnonzero(sizes >= LEAST_EXPONENT * s)
    if len(live):
        hashes = _mixed(spaced.astype(np.uint64))
    while len(live):
        # The texts that are long enough for this scale, with hashes of t = s // 4 words.
        length = sizes[live] + 1
        ends = np.cumsum(length)
        pick = np.repeat(starts[live] - (ends - length), length) + np.arange(ends[-1])
        spaced, hashes = spaced[pick], hashes[pick]
        starts, shift = ends - length, starts[live] - (ends - length)
        back = np.repeat(shift, length)  # to places of the scale before
        sizes = sizes[live]
        to_whole = back if s == direct else to_whole[pick] + back
        while t < s // 4:
            follow = np.r_[hashes[t:], np.zeros(min(t, len(hashes)), np.uint64)]
            hashes, t = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + follow), 2 * t
        usable = hashes >> np.uint64(1)  # below what marks a place without a choice
        usable[~_inside(starts, sizes, t, len(usable))] = _MOST
        short = runs[runs[:, 2] <= t // 4]
        if len(short):
            # Runs in whole places; those within the live texts, in present ones.
            whole = np.arange(len(spaced)) + to_whole
            a = np.searchsorted(whole, short[:, 0])
            here = (a < len(whole)) & (whole[np.minimum(a, len(whole) - 1)] == short[:, 0]) & (short[:, 1] >= t)
            cover = np.zeros(len(spaced) + 1, np.int64)
            np.add.at(cover, a[here], 1)
            np.add.at(cover, a[here] + short[here, 1] - t + 1, -1)
            usable[np.cumsum(cover[:-1]) > 0] = _MOST
        at, lag = _seeds(usable, t, s)
        if len(at):
            more = _extended(spaced, at, lag)
            if len(more):
                more[:, 0] += to_whole[more[:, 0]]
                runs = np.concatenate([runs, more])
        s *= 2
        live = np.flatnonzero(sizes >= LEAST_EXPONENT * s)
    runs = _smallest_periods(runs)
    runs = runs[runs[:, 1] >= np.maximum(least_length, least_exponent * runs[:, 2])]
    # Places without the gaps between texts.
    text = np.searchsorted(begins[:-1] + gaps, runs[:, 0], side="right") - 1
    runs[:, 0] -= text
    return runs


def _inside(starts: np.ndarray, sizes: np.ndarray, t: int, n: int) -> np.ndarray:
    """Places from which t words of one text follow."""
    change = np.zeros(n + 1, np.int64)
    long = sizes >= t
    change[starts[long]] += 1
    change[starts[long] + sizes[long] - t + 1] -= 1
    return np.cumsum(change[:-1]) > 0


def _handled(texts: pa.Array, least_length: int, least_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, runs, collapsed text) of each text."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(real)])
    begins = before[offsets]
    words = words.filter(pa.array(real))
    sizes = np.diff(begins)
    numbers = words.dictionary_encode().indices.to_numpy() if len(words) else np.empty(0, np.int32)
    runs = runs_of(numbers, sizes, least_length, least_exponent)

    # A word goes if a run holds it after its first period.
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(stays)])[begins]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stays)))
    collapsed = pc.binary_join(kept, " ")

    of_text = np.searchsorted(begins, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(of_text, np.arange(len(sizes) + 1))
    each = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begins[of_text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], RUN_FIELDS)
    return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each), collapsed


RUN_FIELDS = ["start", "length", "period"]


def periodic_runs(df: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and period, in words, by start and period) and
    collapsed, the words that no run repeats, joined by one space; columns named in ``carry`` in a struct."""
    common.on_workers(df.sparkSession)
    rows = common.id_text(df, id_col, text_col, carry)
    extra = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                n_words, runs, collapsed = _handled(part.column(1), least_length, least_exponent)
                columns = {"doc_id": part.column(0), "n_words": n_words, "runs": runs, "collapsed": collapsed}
                if carry:
                    columns["carried"] = part.column(2)
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string{extra}")


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in portions of whole texts of about WORDS_AT_ONCE words (six bytes a word)."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    portion = np.cumsum(sizes) // (6 * WORDS_AT_ONCE)
    cuts = [*np.flatnonzero(np.r_[True, portion[1:] != portion[:-1]]), len(batch)] if len(batch) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def with_planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), where the texts of one document in ten repeat a passage from some word on, as its id decides.

    With h the CRC-32 of the id's decimals, g = h div 10, n words and a = g mod n, each word i >= a becomes word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).  A null id or no words: nothing changes.
    """
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    rows = common.id_text(df, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    chosen = (F.col("h") % 10 == 0)
    rows = rows.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(chosen & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then that with the smaller period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, with their digests."""
    found = periodic_runs(with_planted(common.table(spark, sf_dir, "documents"))).withColumn("top", _longest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.before")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.shorter")).alias("period"),
        F.expr("1000 * top.length div -top.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
