"""Exact dedup by a content sort, with DataFrame functions only.

Every run of white space becomes one space; the normalised texts are
range-partitioned at sampled splitters (``repartitionByRange``), sorted
externally, and compared in full with their neighbours: a window over equal
texts, which Spark evaluates by comparing each row's key bytes with those of the
row before it.  Splitters are sampled from the first PREFIX characters and, where
many texts begin alike, a hash of the text, so that the driver gets no whole
texts; texts are sorted by these first.  The range partitioning already clusters
equal texts, so the window adds no shuffle, and texts cross the network once.

Hot texts: a first pass counts 64-bit text hashes (combined before the shuffle).
A text with more than ``max(HOT_ROWS, rows / HOT_SHARE)`` rows has its rows
dealt over salts, about HOT_ROWS-to-threshold rows each; at most HOT_SHARE
hashes can be that frequent, which bounds what is broadcast.  Each salted run is
sorted and compared alike, and the runs' first rows, one per salt, are joined up
by a second comparison of whole texts.  The hash only decides on salting; it
never decides on equality.

Defined results: null text counts as empty; empty texts are equal to each other;
of rows with the same text and the same id one stays; a row with a null id stays
only if its text has no row with an id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A text with more rows than this may be hot.
HOT_ROWS = 512
#: No more texts than this can be hot.
HOT_SHARE = 65536
#: Characters of a text that splitters are sampled from.
PREFIX = 32
#: Runs that are more than one space: longer ones, or single other characters.
_SPACES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = common.id_text(df, id_col, text_col).select("doc_id", F.regexp_replace("text", _SPACES, " ").alias("norm"))

    hot = hot_texts(rows)
    salted = (
        rows.withColumn("h", F.xxhash64("norm"))
        .join(F.broadcast(hot), "h", "left")
        .select("doc_id", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), "h",
                F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(-1)).alias("salt"))
    )
    placed = salted.repartitionByRange("prefix", "h", "salt")
    run = Window.partitionBy("prefix", "h", "norm", "salt").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = placed.select(
        "doc_id",
        "salt",
        F.row_number().over(run).alias("n"),
        F.first("doc_id").over(whole).alias("run_id"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        "norm",
    )
    # Salted runs of one text meet again here: one row per salt, whole texts compared.
    joined_up = (
        runs.where("salt >= 0 and n = 1")
        .groupBy("norm")
        .agg(F.min("run_id").alias("hot_id"), F.sum("run_size").alias("hot_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "hot_id", "hot_size")
    )
    out = runs.select("doc_id", "salt", "n", "run_id", "run_size", F.sha2("norm", 256).alias("text_sha256"))
    keep_id = F.when(F.col("salt") >= 0, F.col("hot_id")).otherwise(F.col("run_id"))
    return out.join(F.broadcast(joined_up), "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("salt") >= 0, F.col("hot_size")).otherwise(F.col("run_size")).cast("long").alias("group_size"),
        ((F.col("n") == 1) & F.col("run_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def hot_texts(rows: DataFrame) -> DataFrame:
    """(h, salts) of the texts with so many rows that they must be dealt over tasks; at most HOT_SHARE."""
    counts = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    return counts.where(F.col("n") > limit).select("h", F.ceil(F.col("n") / F.lit(limit)).alias("salts"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
