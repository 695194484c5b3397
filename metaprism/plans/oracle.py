"""Compare a Spark result with its DuckDB SQL twin (used by tests and tools)."""

from __future__ import annotations

import math

import pandas as pd

from ..session import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0) > 0:
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if v is None or pd.isna(v):
        return None
    if hasattr(v, "item"):
        return v.item()
    return v


def norm_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = norm_rows(spark_pdf)
    dc, dr = norm_rows(sql_pdf)
    if sc != dc:
        return False, f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return False, f"row counts differ: {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, first: {bad[0]}"
    return True, f"{len(sr)} rows"
