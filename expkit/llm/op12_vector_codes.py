"""Vector codes: one small codebook a part of the vector, fitted by active-entry Lloyd.

Components become integers floor(scale * x); a vector is cut into equal
consecutive parts, and each part position has its own codebook.  A codebook
starts as that part of the vectors with the smallest ids.  Each round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower
index) and replaces each used entry by the rounded-down mean of its parts; after
the last round the parts are assigned again.

Assignments after the first look at few entries.  A part whose assigned entry
stayed fixed still has its stored, exact distance, and no other fixed entry can
have come closer; so it compares only the entries that moved, a tie going to the
lower index.  A part whose entry moved is compared with the whole codebook.

A round is one pass over a stored table that holds the integer vectors with their
codes and distances.  Tasks write the next such table, and beside its rows one
row per used entry with the sum of its parts; those sums meet in a ``groupBy``,
and only codebooks (entries x components numbers, whatever the number of rows)
reach the driver and go out again with the next pass.  Each table is removed when
the next one is written, so two of them exist at most.

Defined results: vectors that are null or hold a null or non-finite component are
dropped; rows that share an id are coded each; a null id comes after all others
when the first entries are picked, and repeated ids come in the order of their
vectors; with fewer rows than entries the codebook is as small as the table; an
empty table gives no rows and empty codebooks; empty vectors have distance 0 to
entry 0.  Vectors of unequal length, a length that the parts don't divide, and
components beyond what 64-bit distances hold (for 16 components a part, integers
beyond 2^28) are refused with a ``ValueError``.  Other columns come along where
named in ``carry`` and are ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows compared with a codebook at a time.
SLICE = 8192
#: Up to here, squared distances are exact in floating point.
EXACT = 1 << 53
#: Copies of a total that rows of one label are spread over.
SPREAD = 16


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; exact, as long as the caller picked a type that holds them."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index."""
    all_of_them = distances(x, entries)
    code = all_of_them.argmin(axis=1)
    return code, all_of_them[np.arange(len(x)), code]


def reassigned(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after those with an index in ``moved`` (ascending) moved, from the assignment before."""
    if not len(moved):
        return code, error
    code, error = code.copy(), error.copy()
    lost = np.isin(code, moved)
    if lost.any():
        code[lost], error[lost] = nearest(x[lost], entries)
    kept = np.flatnonzero(~lost)
    if len(kept):
        best, d = nearest(x[kept], entries[moved])
        best = moved[best]
        closer = (d < error[kept]) | ((d == error[kept]) & (best < code[kept]))
        code[kept[closer]], error[kept[closer]] = best[closer], d[closer]
    return code, error


def _sums(x: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Componentwise sums of the rows of each entry, with their number in a last column."""
    out = np.zeros((n, x.shape[1] + 1), np.int64)
    order = np.argsort(code, kind="stable")
    used, at = np.unique(code[order], return_index=True)
    if len(used) and x.shape[1]:
        out[used, :-1] = np.add.reduceat(x[order].astype(np.int64), at, axis=0)
    out[:, -1] = np.bincount(code, minlength=n)
    return out


def _flat(column: pa.Array, rows: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _pass(schema: pa.Schema, carried: int, codebooks: np.ndarray, moved: list[np.ndarray] | None, kind, scale: int | None, sums: bool):
    """The function of one pass: ``scale`` turns raw vectors into integers, ``moved`` is None in the first one."""
    parts, n, width = codebooks.shape
    books = codebooks.astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, n, width + 1), np.int64)
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                rows = len(batch)
                vectors = batch.column(carried)
                if scale is None:
                    ints = _flat(vectors, rows, np.int64) if width else np.zeros((rows, 0), np.int64)
                else:
                    ints = np.floor(scale * _flat(vectors, rows, np.float64)).astype(np.int64) if width else np.zeros((rows, 0), np.int64)
                x = ints.astype(kind)
                codes, errors = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
                if moved is not None:
                    codes, errors = _flat(batch.column(carried + 1), rows, np.int64), _flat(batch.column(carried + 2), rows, np.int64)
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    if moved is None:
                        code, error = nearest(own, books[p])
                    else:
                        code, error = reassigned(own, books[p], moved[p], codes[:, p], errors[:, p].astype(kind))
                    codes[:, p], errors[:, p] = code, error
                    if sums:
                        total[p] += _sums(ints[:, p * width : (p + 1) * width], codes[:, p], n)
                lists = [_lists(ints, pa.int32()), _lists(codes, pa.int16()), _lists(errors, pa.int64())]
                gone = [pa.nulls(rows, schema.field(i).type) for i in range(carried + 3, len(schema))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(carried)), *lists, *gone], schema=schema)
        if sums:
            part, entry = np.nonzero(total[:, :, -1])
            none = [pa.nulls(len(part), schema.field(i).type) for i in range(carried + 3)]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), _lists(total[part, entry], pa.int64())], schema=schema)

    return run


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _moments(state: DataFrame) -> dict[tuple[int, int], list[int]]:
    """Sums and counts of the used entries: as many numbers as the codebooks hold."""
    totals = (
        state.where("part is not null").select("part", "entry", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at").agg(F.sum("value").alias("value"))
    )
    out: dict[tuple[int, int], list] = {}
    for r in totals.collect():
        out.setdefault((r["part"], r["entry"]), []).append((r["at"], r["value"]))
    return {k: [v for _, v in sorted(values)] for k, values in out.items()}


def compress(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id",
             vector_col: str = "embedding", carry: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """(rows, codebooks): rows of ``vec_id``, ``carried`` (a struct, where columns are named), ``ints``, ``codes``
    and ``errors`` (squared distance a part); codebooks[part][entry] lists integers."""
    spark = df.sparkSession
    common.on_workers(spark)
    numbered, (own_id, vector, *others) = common.picked(df, id_col, vector_col, *carry)
    with_it = [F.struct(*(c.alias(n) for c, n in zip(others, carry, strict=True))).alias("carried")] if carry else []
    # Floats become doubles first, and products with a power of two are exact, so both sides of floor() agree with SQL.
    rows = numbered.select(own_id.cast("long").alias("vec_id"), *with_it, vector.cast("array<double>").alias("vector")).where(
        "vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    named = ["vec_id", *(["carried"] if carry else [])]

    shape = rows.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"),
                     F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).first()
    state_type = f"vec_id long, {'carried ' + rows.schema['carried'].dataType.simpleString() + ', ' if carry else ''}ints array<int>, codes array<smallint>, errors array<bigint>"
    if shape["least"] is None:
        return spark.createDataFrame([], state_type), [[] for _ in range(parts)]
    if shape["least"] != shape["most"] or shape["least"] % parts:
        raise ValueError(f"vectors of {shape['least']} to {shape['most']} components don't fall into {parts} equal parts")
    width = shape["least"] // parts
    # |x - c|^2 = x^2 - 2xc + c^2: each of the terms stays below 4 * width * bound^2.
    bound = int(np.ceil(scale * (shape["largest"] or 0.0))) + 1
    if 4 * width * bound * bound >= 1 << 63:
        raise ValueError(f"components up to {shape['largest']} are too large for exact distances")
    kind = np.float64 if 4 * width * bound * bound < EXACT else np.int64

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.floor(scale * np.array([r["vector"] for r in first], np.float64)).astype(np.int64).reshape(len(first), parts, width)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2))

    full_type = state_type + ", part int, entry int, sums array<bigint>"
    schema = pa.schema([pa.field("vec_id", pa.int64()), *_carried_field(rows, carry), pa.field("ints", pa.list_(pa.int32())),
                        pa.field("codes", pa.list_(pa.int16())), pa.field("errors", pa.list_(pa.int64())),
                        pa.field("part", pa.int32()), pa.field("entry", pa.int32()), pa.field("sums", pa.list_(pa.int64()))])

    def step(source: DataFrame, moved, scale_now, sums: bool) -> tuple[DataFrame, str]:
        run = _pass(schema, len(named), codebooks, moved, kind, scale_now, sums)
        path = common.shared_path(spark, "vector-codes")
        return common.stored_at(source.mapInArrow(run, full_type), path), path

    state, path = step(rows.select(*named, "vector"), None, scale, rounds > 0)
    for i in range(rounds):
        moved = [[] for _ in range(parts)]
        for (part, entry), (*total, n) in _moments(state).items():
            mean = np.array([t // n for t in total], np.int64)
            if (mean != codebooks[part, entry]).any():
                codebooks[part, entry] = mean
                moved[part].append(entry)
        data = state.where("part is null").select(*named, "ints", "codes", "errors")
        following, next_path = step(data, [np.array(sorted(m), np.int64) for m in moved], None, i + 1 < rounds)
        common.removed(spark, path)
        state, path = following, next_path
    return state.where("part is null").select(*named, "ints", "codes", "errors"), codebooks.tolist()


def _carried_field(rows: DataFrame, carry: tuple[str, ...]) -> list[pa.Field]:
    if not carry:
        return []
    from pyspark.sql.pandas.types import to_arrow_schema

    return [to_arrow_schema(rows.select("carried").schema).field(0)]


def codebook_text(codebooks: list) -> str:
    """All components by part, entry and position, joined by commas."""
    return ",".join(str(c) for part in codebooks for entry in part for c in entry)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, the errors of their labels and the digest of the codebooks."""
    rows, codebooks = compress(common.table(spark, sf_dir, "embeddings"), carry=("label",))
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    coded = rows.select(
        "vec_id", F.col("carried.label").alias("label"),
        F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0")), "").alias("code"),
        F.aggregate("errors", F.lit(0).cast("long"), lambda a, e: a + e).alias("error"),
        F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int").alias("copy"),
    )
    # One total a label, in as many copies as a label's rows are spread over.
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("of_copy"))
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("copy") == F.col("of_copy")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = 4) -> str:
    """The same by plain search: every part against every entry in every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, p, any_value(x) AS x, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS b
  FROM parts JOIN c{k} USING (p) GROUP BY rid, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS MATERIALIZED (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (
    SELECT p, b.e AS e, i, sum(x[i]) AS s, count(*)::DOUBLE AS n FROM a{k}, (SELECT unnest(range(1, w + 1)) AS i FROM dims) GROUP BY p, b.e, i)
  GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT max(len(v)) // 4 AS w FROM kept),
parts AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, dims, (SELECT unnest(range(4)) AS p)),
c0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM parts WHERE rid < 256),{",".join(steps)},
coded AS MATERIALIZED (
  SELECT rid, string_agg(lpad(lower(to_hex(b.e)), 2, '0'), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
book AS (SELECT sha256(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
         FROM (SELECT p, e, unnest(c) AS value, unnest(range(1, len(c) + 1)) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) CROSS JOIN book
"""


ORACLE = _oracle()
