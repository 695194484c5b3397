"""Splits, sampling and resampling.

Randomness is a mixing hash of the row key and a seed (the same expression
runs in SQL), so folds and samples are repeatable and checkable.
Ranks use the skew-proof distributed ranking (range partitioning + offsets).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, keyed
from ..functions.ranking import rank_within

def hkey(row_id: Column, seed: int) -> Column:
    """60-bit draw of a row and a seed: the head of MD5 of ``row:seed``.

    Every bit mixes, so draws modulo any number are even, different seeds are
    independent, and the same draw can be written in SQL."""
    text = F.concat_ws(":", row_id.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sql_hkey(row_id: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({row_id} AS VARCHAR) || ':{seed}'), 1, 15)) AS BIGINT)"


def kfold_stratified(fr: Frame, k: int = 3, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Adds ``fold``; per class, fold sizes differ by at most one.

    shuffle=True: rows of a class ranked by the seeded hash, fold = rank mod k.
    shuffle=False: the unshuffled stratified rule - classes laid out in sorted
    order and dealt round-robin into k folds, each class's rows (in row-key
    order) filling its fold allocation in turn.

    Without a row key the rows' order stands for one.
    """
    shown, fr = fr.df.columns, keyed(fr)
    rid = F.col(fr.row_id)
    df = fr.df.withColumn("_y", fr.y())
    if shuffle:
        ranked = rank_within(df.withColumn("_h", hkey(rid, seed)), ["_y"], ["_h", fr.row_id], "_rk")
        return ranked.withColumn("fold", (F.col("_rk") % k).cast("int")).select(*shown, "fold")
    from ..frame import collect_bounded
    counts = {r["_y"]: r["count"] for r in collect_bounded(df.groupBy("_y").count(), "classes")}
    classes = sorted(counts)
    start, bounds = 0, {}
    for c in classes:
        m = counts[c]
        alloc = [((start + m - 1 - i) // k) - ((start - 1 - i) // k) for i in range(k)]
        cum, acc = [], 0
        for a in alloc:
            acc += a
            cum.append(acc)
        bounds[c] = cum
        start += m
    ranked = rank_within(df, ["_y"], [fr.row_id], "_rk")
    fold = F.lit(0)
    for c, cum in bounds.items():
        f_c = sum((F.col("_rk") >= F.lit(b)).cast("int") for b in cum[:-1]) if k > 1 else F.lit(0)
        fold = F.when(F.col("_y") == c, f_c).otherwise(fold)
    return ranked.withColumn("fold", fold.cast("int")).select(*shown, "fold")


def kfold_plain(fr: Frame, k: int = 3, seed: int = 42) -> DataFrame:
    """R2: global rank by the seeded hash, fold = rank mod k."""
    shown, fr = fr.df.columns, keyed(fr)
    df = fr.df.withColumn("_h", hkey(F.col(fr.row_id), seed))
    return rank_within(df, [], ["_h", fr.row_id], "_rk").withColumn(
        "fold", (F.col("_rk") % k).cast("int")).select(*shown, "fold")


def sample_rows(fr: Frame, frac: float, seed: int = 42) -> DataFrame:
    """Exactly int(frac * n) rows without replacement (frac in [0.5, 1])."""
    if not 0.5 <= frac <= 1.0:
        raise ValueError("lm_sample_frac must be in [0.5, 1.0]")
    shown, fr = fr.df.columns, keyed(fr)
    n = fr.count()
    keep = int(n * frac)
    df = fr.df.withColumn("_h", hkey(F.col(fr.row_id), seed))
    return rank_within(df, [], ["_h", fr.row_id], "_rk").where(F.col("_rk") < keep).select(*shown)


def bootstrap_weights(fr: Frame, replicates: int = 128, seed: int = 1234, keep=()) -> DataFrame:
    """R4 helper: (row_id, *keep, rep, w) Poisson(1) weights from a hash, w > 0 only.

    Each (row, replicate) draws a uniform from xxhash64 and inverts the
    Poisson(1) CDF; rows never leave their partition until the weighted
    aggregate of the statistic of interest.
    """
    fr = keyed(fr)
    u = (F.pmod(F.xxhash64(F.col("row_id"), F.col("rep"), F.lit(seed)), F.lit(1 << 30)).cast("double")
         / float(1 << 30))
    cdf, terms, p = [], [], math.exp(-1.0)
    acc = 0.0
    for kk in range(12):
        acc += p
        cdf.append(acc)
        p = p / (kk + 1)
    w = sum((u > F.lit(c)).cast("int") for c in cdf)
    return (fr.df.select(F.col(fr.row_id).alias("row_id"), *keep, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
            .withColumn("w", w).where(F.col("w") > 0))


def interpolate_rows(fr: Frame, seed: int = 0) -> DataFrame:
    """Per class, as many convex blends of two rows of the class, both
    drawn at random by hash, with one weight per element.  The drawn rows are
    joined by (class, rank) - equi-joins, no pairs.  The row key names the blend."""
    fr = keyed(fr)
    base = fr.df.withColumn("_y", fr.y()).select(fr.row_id, "_y", *fr.num)
    ranked = rank_within(base, ["_y"], [fr.row_id], "_rk")
    sizes = ranked.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))  # one row a class
    rid = F.col(fr.row_id)
    r = ranked.select(fr.row_id, "_y").join(sizes, "_y")
    for side in (0, 1):
        r = r.withColumn(f"_rk{side}", hkey(rid, 2 * seed + side) % F.col("_n"))
        ends = ranked.select("_y", F.col("_rk").alias(f"_rk{side}"), *[F.col(c).alias(f"_e{side}_{c}") for c in fr.num])
        r = r.join(ends, ["_y", f"_rk{side}"])
    blends = []
    for i, c in enumerate(fr.num):
        t = hkey(rid, 1_000_003 * (seed + 1) + i).cast("double") / float(1 << 60)
        blends.append((F.col(f"_e0_{c}") * t + F.col(f"_e1_{c}") * (1.0 - t)).alias(c))
    return r.select(fr.row_id, *blends, F.col("_y").alias(fr.label))


def bootstrap_ci(fr: Frame, statistic: str = "mean", replicates: int = 128, confidence=(0.95,),
                 seed: int = 1234) -> DataFrame:
    """Basic bootstrap intervals theta - quantile(theta* - theta) for the
    mean or sd of every numeric column, all replicates in one pass over the
    rows (``resampling``).  Returns (attr, theta, confidence, lower, upper)."""
    from .resampling import intervals, replicate_values, resampled  # it draws by hkey, above
    re = resampled(fr, replicates, seed)
    values = replicate_values(re, statistic) if re.rows else []
    rows = [(c, float(values[0][i]), *found) for i, c in enumerate(fr.num) if values
            for found in intervals(np.array([v[i] for v in values]), confidence)]
    return fr.spark.createDataFrame(rows, "attr string, theta double, confidence double, lower double, upper double")
