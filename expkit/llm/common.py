"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from expkit.sources.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The table with columns numbered, and the named ones, told apart by their exact names."""
    numbered = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return numbered, [F.col(f"_{df.columns.index(name)}") for name in names]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the id (long) and the text (null: empty) of a table, whatever else it holds.

    Columns named in ``carry`` come along in one struct, ``carried``, so that their
    names meet no others.
    """
    numbered, (doc_id, text, *others) = picked(df, id_col, text_col, *carry)
    out = [doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text")]
    if carry:
        out.append(F.struct(*(c.alias(n) for c, n in zip(others, carry, strict=True))).alias("carried"))
    return numbered.select(*out)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it (or ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when it ends, the worker gives back what Arrow has freed but still holds.

    Workers wait for tasks of later steps, whose memory they would share with what they hold.
    """

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run_and_release


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back."""
    return stored_at(df, shared_path(df.sparkSession, name), *partition_by)


def stored_at(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df`` written as a Parquet table under ``path`` and read back."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} isn't in the shared folder")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
