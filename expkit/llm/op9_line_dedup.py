"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches.  ``LineRuns`` keeps, in the shared folder, sorted
runs of (128-bit line hash, number of documents), arranged in levels: a batch
writes one run at level 0, and whenever a level holds ``fanout`` runs they are
merged into one run of the next level, counts added up.  Before a batch writes
its run it is merge-anti-joined with the runs: a line that the runs already
know to be in enough documents brings nothing new and is left out, so very
common lines stop growing.  Lines of a batch are counted per document and
combined before they are shuffled; a line in a third of all documents costs one
row per task.

When all batches are in, the runs name the lines found in at least
``min_docs`` documents, and every document loses all of those.  Lines in more than
one of HOT_SHARE of all line rows, at most HOT_SHARE of them, are looked up where
they are; the others are merge-joined.

Defined results: a null or empty text is one empty line; empty keys are never
dropped; a document is a doc_id (null ids count as one document); repeated rows
come out repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]
#: No more lines than this are looked up without a shuffle.
HOT_SHARE = 4096


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _UPPER.lower())


class LineRuns:
    """Levels of sorted runs (h1, h2, n_docs) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.compactions = 0

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, counts: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(common.stored(counts.select(*HASH, "n_docs").sortWithinPartitions(*HASH), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self.compactions += 1
            self._write(_added_up(merged), level + 1)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2); no document may be in two batches."""
        own = lines.groupBy(*HASH).agg(F.count_distinct(F.coalesce("doc_id", F.lit(-(2**63)))).alias("n_docs"))
        if runs := self._runs():
            known = runs[0]
            for run in runs[1:]:
                known = known.unionByName(run)
            known = known.where(F.col("n_docs") >= self.min_docs)
            own = own.join(known.hint("merge"), HASH, "left_anti")
        self._write(own, 0)

    def frequent(self) -> DataFrame:
        """(h1, h2, n_docs) of the lines found in at least ``min_docs`` documents."""
        return _added_up(self._runs()).where(F.col("n_docs") >= self.min_docs)


def _added_up(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))


def dedup_lines(df: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3,
                id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text that is left), and what is to be carried."""
    spark = df.sparkSession
    docs = common.id_text(df, id_col, text_col, carry).withColumn("text_hash", F.xxhash64("text"))
    keys = (
        docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("k"))
        .where(F.char_length("k") >= max(1, min_chars))
        .select("doc_id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"),
                F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    )
    keys = common.stored(keys, "line-keys", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch))

    # A row is known by its id and text, so rows that share an id keep their own lines.
    frequent = common.cut_lineage(runs.frequent())
    # No more than HOT_SHARE lines can be in more than this many documents.
    hot = F.broadcast(frequent.where(F.col("n_docs") > keys.count() // HOT_SHARE).select(*HASH))
    dropped = keys.join(hot, HASH, "left_semi").unionByName(
        keys.join(hot, HASH, "left_anti").join(frequent.select(*HASH).hint("merge"), HASH, "left_semi")
    )
    drop = (
        dropped.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drop")
    )
    carried = ["carried"] if carry else []
    same_row = docs["doc_id"].eqNullSafe(F.col("drop_id")) & (docs["text_hash"] == F.col("drop_hash"))
    hit = docs.join(drop.hint("shuffle_hash"), same_row, "left").select("doc_id", "drop", *carried, F.split("text", "\n", -1).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.array_except(every, F.coalesce("drop", F.array().cast("array<int>")))
    return hit.select("doc_id", *carried, "lines", left.alias("left")).select(
        "doc_id",
        *carried,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
        F.array_join(F.expr("transform(left, i -> lines[i])"), "\n").alias("kept"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents leave all documents."""
    return dedup_lines(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id,
       count(*) AS n_lines,
       count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k)
GROUP BY doc_id
"""
