"""Distributed dense ranking of distinct values.

``sorted_levels`` gives every distinct value its 0-based position in sorted
order without a single-partition window: values are range-partitioned
(``repartitionByRange``), each partition is ranked locally, and a tiny table
of per-partition counts (one row per partition) turns local ranks into global
ones.  Works for any number of levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _ranged(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned on ``keys`` with the partition number as
    ``_pid``, fixed by a reliable checkpoint: the range bounds come from a
    sample, so both readers must see the one written copy."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def sorted_levels(values: DataFrame, col: str = "value", partitions: int | None = None) -> DataFrame:
    """(value, code) with code = rank of value among the sorted distinct values."""
    d = values.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranged = _ranged(d, ["value"], partitions)
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy("value")) - 1)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # offsets: one row per partition -> cumulative sum over a handful of rows
    offs = counts.select("_pid", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_off"))
    return (local.join(F.broadcast(offs), "_pid")
            .select("value", (F.col("_off") + F.col("_r")).cast("long").alias("code")))


def level_codes(df: DataFrame, col: str, levels: DataFrame) -> DataFrame:
    """Replace ``col`` by its code in ``levels`` (null / unseen -> null)."""
    lv = levels.select(F.col("value").alias(f"_lv_{col}"), F.col("code").alias(f"_lc_{col}"))
    out = df.join(lv, df[col] == lv[f"_lv_{col}"], "left")
    return out.withColumn(col, F.col(f"_lc_{col}")).drop(f"_lv_{col}", f"_lc_{col}").select(*df.columns)


def rank_within(df: DataFrame, by: list[str], order: list[str], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its ``by`` group, ordered by ``order``.

    Skew-proof: the data is range-partitioned on (by, order), so a group that
    holds a third of all rows is spread over many tasks; each task ranks its
    slice, and a per-(partition, group) count table - partitions x groups rows
    - supplies the offsets.  No window ever sees a whole large group.
    """
    keyed = _ranged(df, [*by, *order], partitions)
    local = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_pid", *by).orderBy(*order)) - 1)
    counts = keyed.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")  # one row per (partition, group)
    offs = counts.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                         (F.sum("_c").over(w) - F.col("_c")).alias("_off"))
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(by):  # a null group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return (local.join(offs, same)
            .withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
            .select(*df.columns, out))
