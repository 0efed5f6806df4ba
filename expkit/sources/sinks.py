"""Sinks (S03, S04) and table routing on the reader side."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expkit.sources.session import ensure_checkpoint_dir


def write_table(df: DataFrame, path_or_name: str, fmt: str = "parquet", as_table: bool = False,
                partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """Full overwrite with schema replacement (the original writes Delta tables; the format is a parameter).

    Large fact tables can be partitioned by date so analysis windows prune files, and bucketed by household
    (``bucket_by=(n, "HOUSEHOLD_ID")``, catalog tables only) so the exposure joins of every metric family read
    co-partitioned files instead of shuffling the facts again.
    """
    w = df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        if not as_table:
            raise ValueError("bucketed output needs a catalog table (as_table=True)")
        n, col = bucket_by
        w = w.bucketBy(n, col).sortBy(col)
    if as_table:
        w.saveAsTable(path_or_name)
    else:
        w.save(path_or_name)


def store(df: DataFrame) -> DataFrame:
    """An intermediate written once to the shared checkpoint folder as Parquet: each of its readers takes only its columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refresh_days(df: DataFrame, path: str, day_col: str, first: str, last: str) -> int:
    """S03, daily cadence: replace the days from ``first`` to ``last`` of a stored table by the rows of ``df``.

    The rows are written to a folder of their own, partitioned by day, and then published: a small list of which folder
    holds which days is created under the next number, in one step that fails if another writer took the number.
    Readers (``read_days``) follow the last list, so they see all of a refresh or none of it; a refresh that is run again
    gives the same table, and one that died before publishing leaves the table as it was.  Rows of other days are
    refused.  Folders that neither of the last two lists names are removed.  Returns the number of the list.
    """
    spark = df.sparkSession
    day = F.col(day_col).cast("date")
    folder = f"data-{uuid.uuid4().hex[:12]}"
    number, published = _published(spark, path)
    df.write.partitionBy(day_col).parquet(f"{path}/{folder}")
    # Looked up among the days written, which builds the rows once.
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    fs, jpath = _files(spark, path)
    if written.where(~F.coalesce(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))).limit(1).count():
        fs.delete(jpath(f"{path}/{folder}"), True)
        raise ValueError(f"rows outside {first} to {last}, or without a day")
    lists = [e for e in published if not (first <= e["first"] and e["last"] <= last)] + [{"folder": folder, "first": first, "last": last, "schema": df.schema.json()}]
    _create(spark, f"{path}/_published/{number + 1:08d}.json", json.dumps(lists))
    kept = {e["folder"] for e in lists} | {e["folder"] for e in published}
    for status in fs.listStatus(jpath(path)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in kept:
            fs.delete(status.getPath(), True)
    return number + 1


def read_days(spark: SparkSession, path: str, day_col: str) -> DataFrame:
    """The table as last published: each folder's days less those that later ones replaced."""
    _, published = _published(spark, path)
    if not published:
        raise FileNotFoundError(f"nothing is published under {path}")
    from pyspark.sql.types import StructType

    day, out = F.col(day_col).cast("date"), None
    for i, e in enumerate(published):
        rows = spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{path}/{e['folder']}")
        for later in published[i + 1:]:
            rows = rows.where(~day.between(F.lit(later["first"]).cast("date"), F.lit(later["last"]).cast("date")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, jvm.org.apache.hadoop.fs.Path


def _published(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number and entries of the last published list (0 and none before the first)."""
    fs, jpath = _files(spark, path)
    folder = jpath(f"{path}/_published")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return 0, []
    text = spark.read.text(f"{path}/_published/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1].split(".")[0]), json.loads(text)


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside, then renamed to a name that must not exist yet."""
    fs, jpath = _files(spark, path)
    beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex[:8]}.new"
    out = fs.create(jpath(beside), False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(jpath(path)) or not fs.rename(jpath(beside), jpath(path)):
        fs.delete(jpath(beside), False)
        raise RuntimeError(f"{path} was published by another writer")


def write_csv_report(df: DataFrame, path: str) -> None:
    """CSV export of the wide output table (a folder of part files, one per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def metric_table(kind: str, database: str, experiment_id: str = "") -> str:
    """A metric table's name, for the refresh that writes it and the analysis that reads it.

    Standard daily tables have the bare name; those of a custom run end in its experiment id.
    """
    if kind not in STANDARD_TABLES:
        raise ValueError(f"unknown metric table {kind!r}")
    return f"{database}.{STANDARD_TABLES[kind]}" + (f"_{experiment_id}" if experiment_id else "")


STANDARD_TABLES = {
    "visit_order": "EXP_VISIT_ORDER", "cart_coupon": "EXP_CART_COUPON", "margin": "EXP_MARGIN", "agp": "EXP_AGP",
    "combined_txns": "EXP_COMBINED_TXNS", "redemptions": "EXP_REDEMPTIONS", "clips": "EXP_CLIPS",
    "gas": "EXP_GAS_TXNS", "bnc": "EXP_BNC", "basket_health": "EXP_BASKET_HEALTH", "category": "EXP_CATEGORY_TXNS",
    "account_health": "EXP_ACC_HEALTH",
}
