"""Exact top-k inner products by columnar branch-and-bound.

Components become integers floor(scale * x); the score is the integer inner
product.  Candidates are dealt into blocks and queries into blocks; a task takes
one block of each; blocks hold a bounded number of components, so memory doesn't
grow with the vectors' length or number.  Within a task the candidates lie in vertical layout, one row
of the matrix per dimension, widest dimensions first.  The first dimensions are
accumulated for a tile of queries and all candidates of the block; then, query by query,
the k best so far are scored in full, which gives a score to reach, and the
search goes on block of dimensions by block of dimensions.  After each, a
candidate stays only if its score so far plus the bound on the rest, the product
of the remaining norms of query and candidate, reaches that score; survivors are
compacted, so later dimensions touch few candidates.  Bounds are rounded up, so
nothing that could tie is lost.

Each block pair reports k rows a query; a window over those, k rows per query
and candidate block, picks the k best.  The queries are a stated set against all
rows, so the work is queries times rows, in blocks of bounded size.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as query or candidate; vectors of different length do not meet;
rows that share the query's id count as its own row; a repeated candidate row
counts again, a repeated query row does not; ties go to the smaller id; empty
tables give no rows; other columns are ignored.  Scores must fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Candidates and queries in a block, at most and (candidates) at least.
MOST_ROWS, LEAST_ROWS, QUERY_ROWS = 65536, 2048, 4096
#: Components in a block, at most, and first scores held at once (8 bytes each).
MOST_COMPONENTS, TILE = 1 << 22, 1 << 22
#: Dimensions accumulated between two prunings.
STEP = 16
#: Up to here, sums of products are exact in floating point.
EXACT = float(1 << 53)


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
                 step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of each query's k best rows of a block; integers in float64."""
    order = np.argsort(-rows.var(axis=0), kind="stable")
    columns = np.ascontiguousarray(rows[:, order].T)
    q = queries[:, order]
    cuts = [*range(step, len(columns), step), len(columns)]
    # Norms of what is left from each cut on.
    left_rows = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts]
    left_q = [np.sqrt((q[:, c:] ** 2).sum(axis=1)) for c in cuts]
    tile = max(1, TILE // max(1, len(ids)))
    found = [(np.empty(0, np.int64),) * 3]
    for j, own in enumerate(query_ids):
        if j % tile == 0:
            first = q[j : j + tile, : cuts[0]] @ columns[: cuts[0]]
        alive = np.flatnonzero(ids != own)
        score, reach = first[j % tile, alive], -math.inf
        if len(alive) > k:  # the most promising rows, scored in full, give the score to reach
            promising = np.argpartition(-(score + left_q[0][j] * left_rows[0][alive]), k - 1)[:k]
            reach = float((q[j] @ columns[:, alive[promising]]).min())
        for i in range(len(cuts) - 1):
            stay = score + left_q[i][j] * left_rows[i][alive] * (1 + 1e-9) + 1 >= reach
            alive, score = alive[stay], score[stay]
            score = score + q[j, cuts[i] : cuts[i + 1]] @ columns[cuts[i] : cuts[i + 1], alive]
            if len(alive) > k:
                sure = score - left_q[i + 1][j] * left_rows[i + 1][alive] * (1 + 1e-9) - 1
                reach = max(reach, float(np.partition(sure, len(sure) - k)[len(sure) - k]))
        best = np.lexsort((ids[alive], -score))[:k]
        found.append((np.full(len(best), j), alive[best], score[best]))
    at, row, score = map(np.concatenate, zip(*found, strict=True))
    return at, row, score


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    common.on_workers(spark)
    usable = F.expr("vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    numbered, (own_id, vector) = common.picked(df, id_col, vector_col)
    rows = numbered.select(own_id.cast("long").alias("id"), vector.alias("vector")).where("id is not null").where(usable)
    rows = rows.withColumn("dims", F.size("vector"))
    queries = rows.where(F.col("id") % every == 0).distinct()

    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max("dims"), F.lit(1))).first()
    # By memory: however long the vectors, a block holds a bounded number of components.
    fits = max(1, MOST_COMPONENTS // dims)
    per_block, per_queries = min(fits, MOST_ROWS, max(LEAST_ROWS, n // 64)), min(fits, QUERY_ROWS)
    row_blocks, query_blocks = max(1, math.ceil(n / per_block)), max(1, math.ceil(n_queries / per_queries))
    # A task is a pair of blocks: rows go to each query block, queries to each row block.
    cell = ["dims", "row_block", "query_block"]
    dealt_rows = rows.select(
        "id", "vector", "dims", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    )
    dealt_queries = queries.select(
        "id", "vector", "dims", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"),
        F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("query_block"),
    )

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        at, row, score = [], [], np.empty(0)
        ids, query_ids = block["id"].to_numpy(), asked["id"].to_numpy()
        if len(ids) and len(query_ids):
            r, q = _matrix(block["vector"], scale), _matrix(asked["vector"], scale)
            if r.shape[1] * np.abs(r).max(initial=0) * np.abs(q).max(initial=0) >= EXACT:
                at, row, score = _in_full(q, query_ids, r, ids, k)
            else:
                at, row, score = search_block(q, query_ids, r, ids, k)
        return pa.table({"query_id": query_ids[np.asarray(at, np.int64)], "vec_id": ids[np.asarray(row, np.int64)], "score": np.asarray(score).astype(np.int64)})

    found = (
        dealt_rows.groupBy(*cell)
        .cogroup(dealt_queries.groupBy(*cell))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _in_full(q: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """For components too large for exact floating point: whole scores in Python integers."""
    at, row, score = [], [], []
    whole = [[int(x) for x in r] for r in rows]
    for j, own in enumerate(query_ids):
        vector = [int(x) for x in q[j]]
        scores = [(-sum(a * b for a, b in zip(vector, r, strict=True)), ids[i], i) for i, r in enumerate(whole) if ids[i] != own]
        for negative, _, i in sorted(scores)[:k]:
            at.append(j), row.append(i), score.append(-negative)
    return at, row, score


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each embedding whose id is divisible by 50."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
) WHERE rank <= 5
"""
