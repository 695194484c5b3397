"""Bindings of the driver's parquet tables to Frames (FIXTURES.md section 3).

Each binding is a projection of a given table; Catalyst prunes the scan to
the columns used, so only those columns are read from parquet.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..session import read_table

LI_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_CAT = ("l_linestatus", "l_linenumber")
LI_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
EM_DIMS = 4


def lineitem_frame(spark: SparkSession, sf_dir: str, label: str = "l_returnflag",
                   with_cat: bool = True) -> Frame:
    """LI: four numeric columns, two text columns, label l_returnflag."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = [F.col(c) for c in LI_NUM]
    cat = []
    if with_cat:
        cols += [F.col("l_linestatus"), F.col("l_linenumber").cast("string").alias("l_linenumber_s")]
        cat = ["l_linestatus", "l_linenumber_s"]
    df = li.select(*LI_KEY, *cols, F.col(label).alias("y"))
    return Frame(df=df, num=LI_NUM, cat=tuple(cat), label="y", row_id=None, name="lineitem")


def embeddings_frame(spark: SparkSession, sf_dir: str, dims: int = EM_DIMS) -> Frame:
    """EM: embedding elements 0..dims-1 as doubles, label = class."""
    em = read_table(spark, sf_dir, "embeddings")
    num = tuple(f"e{i}" for i in range(dims))
    df = em.select(
        F.col("vec_id").alias("row_id"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
        F.col("label").cast("string").alias("y"),
    )
    return Frame(df=df, num=num, cat=(), label="y", row_id="row_id", name="embeddings")


def events_frame(spark: SparkSession, sf_dir: str) -> Frame:
    ev = read_table(spark, sf_dir, "events")
    df = ev.select("event_id", "value", "user_id", F.col("event_type").alias("y"))
    return Frame(df=df, num=("value",), cat=(), label="y", row_id="event_id", name="events")
