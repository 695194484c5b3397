"""Exact order statistics of whole columns without a one-task value map.

Every column's values are counted (copies collapse before the shuffle), the
distinct values are range-partitioned and written once; running counts inside
each partition and one offset per (partition, column) give every value its
rank interval, and only the values at the wanted ranks reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import collect_bounded
from .ranking import _ranged


def value_counts(df: DataFrame, cols: Mapping[str, Column], by: Column | None = None) -> DataFrame:
    """(attr[, grp], value, n) over the non-null values of every column, in one pass."""
    cells = F.array(*[F.struct(F.lit(i).alias("attr"), c.alias("value")) for i, c in enumerate(cols.values())])
    keys = ["attr"] if by is None else ["attr", "grp"]
    long = df.select(F.inline(cells)) if by is None else df.select(by.alias("grp"), F.inline(cells))
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, cols: Mapping[str, Column]) -> dict[str, int]:
    """The number of distinct non-null values of every column: one narrow count
    for the columns of each type, instead of a wide row a column and row."""
    kinds = defaultdict(dict)
    for (c, x), f in zip(cols.items(), df.select(*cols.values()).schema.fields):
        kinds[f.dataType.simpleString()][c] = x
    out = dict.fromkeys(cols, 0)
    for same in kinds.values():
        names = list(same)
        for r in value_counts(df, same).groupBy("attr").count().collect():  # one row a column
            out[names[r["attr"]]] = r["count"]
    return out


def ranged_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of values in value order of every key, written once, with the
    partition number as ``_pid``.  A key of many rows lies over many partitions."""
    return _ranged(counts, [*keys, "value"], None)


def ranks_of_keys(ranged: DataFrame, keys: list[str], ranks) -> dict[tuple, dict[int, float]]:
    """{key: {rank: value}} of 0-based ranks in the sorted values of every key of
    ``ranged_counts``; ``ranks(n)`` names the ranks of a key of n values.  One row
    a key and partition, and one a wanted rank, reach the driver."""
    at = ranged.groupBy("_pid", *keys).agg(F.sum("n").alias("n"))
    totals = sorted(collect_bounded(at, "keys and partitions", 1_000_000), key=lambda r: r["_pid"])  # pids are in value order
    size: dict = defaultdict(int)
    for _, *key, n in totals:
        size[tuple(key)] += n
    need = {key: sorted({r for r in ranks(n) if 0 <= r < n}) for key, n in size.items()}
    wanted, before = [], defaultdict(int)
    for pid, *key, n in totals:
        start = before[tuple(key)]
        wanted += [(*key, pid, r, r - start) for r in need[tuple(key)] if start <= r < start + n]
        before[tuple(key)] += n
    out: dict = {key: {} for key in size}
    if not wanted:
        return out
    types = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    schema = ", ".join([*[f"t_{k} {types[k]}" for k in keys], "t_pid int", "rank long", "inside long"])
    targets = F.broadcast(ranged.sparkSession.createDataFrame(wanted, schema))
    run = Window.partitionBy("_pid", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("_pid") == F.col("t_pid")) & (F.col("upto") > F.col("inside")) & (F.col("upto") - F.col("n") <= F.col("inside"))
    for k in keys:
        hit = hit & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    found = ranged.withColumn("upto", F.sum("n").over(run)).join(targets, hit).select(*keys, "rank", "value")
    for *key, rank, value in found.collect():  # one row a wanted rank
        out[tuple(key)][rank] = value
    return out


def weighted_counts(counts: DataFrame, value: Column) -> DataFrame:
    """Counts of ``value``, an expression of each counted value (attr, value, n)."""
    return (counts.select("attr", value.alias("value"), "n").where(F.col("value").isNotNull())
            .groupBy("attr", "value").agg(F.sum("n").alias("n")))


def at_ranks(df: DataFrame, cols: Mapping[str, Column], ranks) -> dict[str, dict[int, float]]:
    """{column: {rank: value}} of 0-based ranks in sorted order (nulls left out,
    NaN last).  ``ranks(n)`` names the wanted ranks of a column of n values."""
    found = ranks_of_keys(ranged_counts(value_counts(df, cols), ["attr"]), ["attr"], ranks)
    return {c: found.get((i,), {}) for i, c in enumerate(cols)}


def _spots(qs: list[float]):
    """(ranks for ``ranks_of_keys``, {rank: value} -> quantiles by linear
    interpolation between neighbouring ranks, None without values)."""
    at = lambda n: [(math.floor(q * (n - 1)), math.ceil(q * (n - 1)), q * (n - 1)) for q in qs]

    def ranks(n):
        return [r for lo, hi, _ in at(n) for r in (lo, hi)] + [n - 1]

    def read(v):
        if not v:
            return None
        return [v[lo] if v[lo] == v[hi] else (hi - p) * v[lo] + (p - lo) * v[hi] for lo, hi, p in at(max(v) + 1)]
    return ranks, read


def quantiles_of_keys(ranged: DataFrame, keys: list[str], qs: Iterable[float]) -> dict[tuple, list[float]]:
    """Quantiles of every key of ``ranged_counts``."""
    ranks, read = _spots(list(qs))
    return {key: read(v) for key, v in ranks_of_keys(ranged, keys, ranks).items()}


def quantiles(df: DataFrame, cols: Mapping[str, Column], qs: Iterable[float]) -> dict[str, list[float] | None]:
    """Quantiles by linear interpolation between neighbouring ranks; None for a
    column without values."""
    ranks, read = _spots(list(qs))
    return {c: read(v) for c, v in at_ranks(df, {c: x.cast("double") for c, x in cols.items()}, ranks).items()}


def group_quantiles(df: DataFrame, cols: Mapping[str, Column], by: Column, qs: Iterable[float]) -> DataFrame:
    """(grp, column -> array of quantiles or null): one row a group of ``by``,
    whatever share of the rows it holds.  Groups times columns are at most a million."""
    counts = value_counts(df, {c: x.cast("double") for c, x in cols.items()}, by)
    found = quantiles_of_keys(ranged_counts(counts, ["attr", "grp"]), ["attr", "grp"], qs)
    groups: dict = {}
    for (attr, grp), v in found.items():
        groups.setdefault(grp, [None] * len(cols))[attr] = [float(x) for x in v]
    schema = T.StructType([T.StructField("grp", df.select(by).schema[0].dataType),
                           *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in cols]])
    return df.sparkSession.createDataFrame([(g, *v) for g, v in groups.items()], schema)


def modes(df: DataFrame, cols: Mapping[str, Column]) -> dict:
    """The most frequent value of every column, the smallest of equals."""
    names = list(cols)
    top = (value_counts(df, cols).groupBy("attr")
           .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("m")).collect())  # one row a column
    found = {names[r["attr"]]: r["m"]["value"] for r in top}
    return {c: found.get(c) for c in names}
