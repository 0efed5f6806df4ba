"""Contiguous, byte-balanced shards from global prefix sums.

Rows are range-partitioned by id.  Each partition reports its byte total (one
small row per partition), the totals are summed up in partition order, and a
row's global byte offset is its partition's offset plus the running sum within
the partition.  The offset axis is cut at ``n_shards`` equal targets: a row
belongs to the shard in which it starts.  Shards are therefore contiguous in id
order and differ from the target by less than one row.

The range partitioning is fixed by a checkpoint of three narrow columns, since
a second run of the sampling behind it could draw other bounds than those the
totals were taken with.

Defined results: a null text has size 1 (its byte count 0 plus 1) and CRC 0; a
null id comes first; rows that share an id are ordered by CRC and size; an empty
table gives no rows; other columns are ignored.  Copies of a text are not kept
together: a group may hold a third of all bytes, which no balanced cut allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def shard_by_bytes(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (position in the shard), byte_offset."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    order = ["doc_id", "text_crc32", "size"]
    rows = common.id_text(df, id_col, text_col).select(
        "doc_id",
        (common.utf8_length(F.col("text")) + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    ranged = common.cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # One row per partition, so this window over everything stays small.
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )

    within = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        *order,
        (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_offset"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("position"),
        "all_bytes",
    )
    cut = F.least(F.lit(n_shards - 1), F.expr(f"byte_offset * {n_shards} div all_bytes")).cast("int")
    placed = placed.withColumn("shard", cut)
    starts = placed.groupBy("shard").agg(F.min("position").alias("first_position"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first_position")).alias("slot"), "byte_offset"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return shard_by_bytes(common.table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
