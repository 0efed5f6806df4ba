"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's check:
row count, column names, order-insensitive hash of the values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb
import pandas as pd

from expkit.sources.adapters import BASE_TABLES

ORACLE_TABLES = BASE_TABLES + ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def frame_digest(rows: list[tuple], cols: list[str]) -> tuple[int, list[str], str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    normed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return len(rows), sorted(cols), h


def spark_rows(df) -> tuple[list[tuple], list[str]]:
    return [tuple(r) for r in df.collect()], list(df.columns)


def duck_rows(con, sql: str) -> tuple[list[tuple], list[str]]:
    rel = con.sql(sql)
    return rel.fetchall(), list(rel.columns)


def compare(df, con, sql: str) -> dict:
    srows, scols = spark_rows(df)
    drows, dcols = duck_rows(con, sql)
    s = frame_digest(srows, scols)
    d = frame_digest(drows, dcols)
    out = {"rows_spark": s[0], "rows_duck": d[0], "cols_match": s[1] == d[1], "hash_match": s[2] == d[2]}
    out["ok"] = out["cols_match"] and out["hash_match"] and s[0] == d[0]
    if not out["ok"]:
        out["spark_cols"], out["duck_cols"] = s[1], d[1]
        sset = {repr(tuple(_norm(r[scols.index(c)]) for c in sorted(scols))) for r in srows}
        dset = {repr(tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols))) for r in drows} if s[1] == d[1] else set()
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_duck"] = sorted(dset - sset)[:3]
    return out
