"""Registry of named queries: a Spark builder plus (optionally) DuckDB SQL.

Every builder takes ``(spark, sf_dir)``, reads the driver's parquet tables and
returns a DataFrame.  The SQL text is an independent formulation of the same
result over the pre-registered table views; it is the correctness oracle.
Values are rounded to significant digits on both sides (``sig``/``sql_sig``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import sig, sql_sig


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    group: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, group: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, group)
        return fn
    return deco


def finish_long(df: DataFrame) -> DataFrame:
    """Long form with the value rounded for cross-engine comparison."""
    return df.select(
        F.col("feature").cast("string").alias("feature"),
        F.col("attr").cast("string").alias("attr"),
        F.col("cls").cast("string").alias("cls"),
        F.col("idx").cast("int").alias("idx"),
        sig(F.col("value")).alias("value"),
    )


def sql_long(inner: str) -> str:
    """SQL twin of :func:`finish_long` around a query with the five columns."""
    return (
        "SELECT CAST(feature AS VARCHAR) AS feature, CAST(attr AS VARCHAR) AS attr, "
        "CAST(cls AS VARCHAR) AS cls, CAST(idx AS INTEGER) AS idx, "
        f"{sql_sig('value')} AS value FROM ({inner}) AS q"
    )


def row(feature: str, value: str, attr: str | None = None, cls: str | None = None,
        idx: int | str | None = None, src: str = "") -> str:
    """One SQL SELECT producing a long-form row (or rows when grouped)."""
    a = "NULL" if attr is None else (attr if attr.startswith("(") else f"'{attr}'")
    c = "NULL" if cls is None else cls
    i = "0" if idx is None else str(idx)
    return f"SELECT '{feature}' AS feature, {a} AS attr, {c} AS cls, {i} AS idx, CAST({value} AS DOUBLE) AS value {src}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
