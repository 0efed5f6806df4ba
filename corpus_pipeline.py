"""From raw documents to packed training sequences, one operator a stage.

Each stage works on all that the stage before it kept, written as Parquet and read
again.  Toxic documents go; lines found in many documents leave their texts; one
document of each near-duplicate class stays; secrets are masked; what is left is
packed.  All stages but the last return the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expkit.llm import common, op4_ngram_join, op6_toxicity, op7_secrets, op8_packing, op9_line_dedup
from expkit.llm.op10_bpe import tokenizer_path


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` in their order, with the new text and its length."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.char_length(text)}
    return rows.select(*((new[c] if c in new else F.col("carried").getField(c)).cast(t).alias(c) for c, t in docs.dtypes))


def _carry(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labels at hand, doesn't reject."""
    return op6_toxicity.without_toxic(docs, op6_toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 of them hold."""
    return _with_text(op9_line_dedup.dedup_lines(docs, carry=_carry(docs)), docs, "kept")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each near-duplicate class."""
    return op4_ngram_join.one_of_each_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    found = op7_secrets.scan_secrets(docs, carry=_carry(docs))
    return _with_text(found.withColumn("masked", op7_secrets.redacted()), docs, "masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return op8_packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secrets", secrets),
    ("packing", packing),
]

#: Model scores, MinHash classes and packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
