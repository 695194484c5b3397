"""Typing, encoding and discretising (T1-T10): raw columns -> N, C, y.

Level lists that shape the output schema (one column per level) are read
after their count is checked; equal-frequency bin edges are one exact
``percentile`` aggregate for all columns; codes are column expressions.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, NotComputable, infer_kinds
from ..functions.orderstats import quantiles
from ..functions.ranking import sorted_levels
from .phases import all_level_values, fit_scale

MAX_LEVELS = 1000


def infer_num_cat(df: DataFrame, exclude=(), cat_cols="auto", check_bool: bool = True) -> tuple[list, list]:
    """Numeric / categorical split from the schema; an explicit list
    overrides; ``check_bool`` moves numeric columns with exactly two distinct
    values to categorical (min/max pass + count of other values)."""
    if cat_cols not in ("auto", None):
        cat = [c for c in cat_cols if c in df.columns]
        num = [c for c in df.columns if c not in cat and c not in exclude]
        return num, cat
    num, cat = infer_kinds(df, exclude)
    if cat_cols is None:
        return num + cat, []
    if check_bool and num:
        mm = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(num)],
                    *[F.max(c).alias(f"hi{i}") for i, c in enumerate(num)]).first()
        cand = [(i, c) for i, c in enumerate(num) if mm[f"lo{i}"] is not None and mm[f"lo{i}"] != mm[f"hi{i}"]]
        if cand:
            r = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c) != mm[f"lo{i}"]) & (F.col(c) != mm[f"hi{i}"]))
                         .alias(f"o{i}") for i, c in cand]).first()
            binary = {c for i, c in cand if r[f"o{i}"] == 0}
            cat = cat + [c for c in num if c in binary]
            num = [c for c in num if c not in binary]
    return num, cat


def encode_onehot(fr: Frame, use_all_columns: bool = False) -> Frame:
    """One 0/1 double column ``{col}_{level}`` per level (sorted);
    the first level is dropped unless ``use_all_columns``; a single-valued
    column raises when dropping."""
    df, num = fr.df, list(fr.num)
    for c, levels in all_level_values(fr, list(fr.cat), MAX_LEVELS).items():
        if not use_all_columns and len(levels) < 2:
            raise NotComputable(f"column {c} has a single value")
        keep = levels if use_all_columns else levels[1:]
        df = df.select("*", *[(F.col(c).cast("string") == F.lit(v)).cast("double").alias(f"{c}_{v}") for v in keep])
        num += [f"{c}_{v}" for v in keep]
    df = df.drop(*fr.cat)
    return fr.with_df(df, num=tuple(num), cat=())


def encode_dummies_reduced(fr: Frame) -> Frame:
    """First categorical column keeps all its levels (``c[v]``), the
    others drop their first sorted level (``c[T.v]``); nulls raise."""
    if not fr.cat:
        return fr
    nulls = fr.df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fr.cat]).first()
    if any(nulls[c] for c in fr.cat):
        raise NotComputable("missing values in categorical data")
    df, num = fr.df, list(fr.num)
    for i, (c, levels) in enumerate(all_level_values(fr, list(fr.cat), MAX_LEVELS).items()):
        if i == 0:
            new = [(F.col(c).cast("string") == F.lit(v)).cast("double").alias(f"{c}[{v}]") for v in levels]
            num += [f"{c}[{v}]" for v in levels]
        else:
            new = [(F.col(c).cast("string") == F.lit(v)).cast("double").alias(f"{c}[T.{v}]") for v in levels[1:]]
            num += [f"{c}[T.{v}]" for v in levels[1:]]
        df = df.select("*", *new)
    return fr.with_df(df.drop(*fr.cat), num=tuple(num), cat=())


def equal_freq_edges(fr: Frame, cols=None, num_bins: int | None = None, tol: float = 1e-8) -> dict:
    """T5 fit: per column the edges at quantiles i/b, i = 1..b (linear
    interpolation), dropping an edge within ``tol`` of its predecessor."""
    cols = list(cols if cols is not None else fr.num)
    if not cols:
        return {}
    n = fr.count()
    b = num_bins or int(n ** (1 / 3))
    qs = [i / b for i in range(1, b + 1)]
    out = {}
    for c, e in quantiles(fr.df, {c: F.col(c) for c in cols}, qs).items():
        e = e or []
        out[c] = sorted({x for j, x in enumerate(e) if j == 0 or e[j] - e[j - 1] > tol})
    return out


def _edges_below(df: DataFrame, edges: dict) -> DataFrame:
    """``df`` with each column of ``edges`` replaced by the number of edges
    strictly below its value, found by binary search (``Bucketizer``): edges
    grow with the rows, so a comparison with each would be more than linear."""
    finite = {c: sorted({x + 0.0 for x in e if math.isfinite(x)}) for c, e in edges.items()}
    seek = {c: f"_edges{i}" for i, c in enumerate(edges) if finite[c]}
    columns = df.columns
    if seek:
        # values and edges negated: its bins contain their lower bound; adding 0.0 makes -0.0 the same as 0.0
        df = df.withColumns({f"{t}v": F.coalesce(-F.col(c).cast("double") + 0.0, F.lit(0.0)) for c, t in seek.items()})
        df = Bucketizer(inputCols=[f"{t}v" for t in seek.values()], outputCols=[f"{t}b" for t in seek.values()], handleInvalid="keep",
                        splitsArray=[[-math.inf, *(0.0 - x for x in reversed(finite[c])), math.inf] for c in seek]).transform(df)

    def code(c):
        x, n = F.col(c).cast("double"), len(finite[c])
        below = F.when(F.isnan(x), F.lit(n)).otherwise(F.lit(n) - F.col(f"{seek[c]}b").cast("int")) if c in seek else F.lit(0)
        for e in {e for e in edges[c] if math.isinf(e)}:
            below = below + (x > F.lit(e)).cast("int")
        return (F.when(x.isNotNull(), below) if edges[c] else below).cast("int")
    return df.select(*[code(c).alias(c) if c in edges else F.col(f"`{c}`") for c in columns])


def discretise_equal_freq(fr: Frame, cols=None, num_bins: int | None = None, edges: dict | None = None) -> Frame:
    """T5 apply: code = number of edges strictly below the value (int)."""
    edges = edges if edges is not None else equal_freq_edges(fr, cols, num_bins)
    df = _edges_below(fr.df, edges)
    moved = [c for c in fr.num if c in edges]
    return fr.with_df(df, num=tuple(c for c in fr.num if c not in edges), cat=fr.cat + tuple(moved))


def rescale_numeric(fr: Frame, option: str = "standard") -> Frame:
    """Whole-matrix rescale before extraction (no rounding)."""
    names = {"standard": "standard_scaler", "min-max": "min_max", "robust": "robust_scaler"}
    return fit_scale(fr, names[option], round_digits=None, as_float=False).transform(fr)


def build_C(fr: Frame, transform_num: bool = True, num_bins: int | None = None) -> Frame:
    """Categorical view = categorical columns + discretised numerics."""
    if not transform_num or not fr.num:
        return fr.with_df(fr.df.drop(*fr.num), num=())
    return discretise_equal_freq(fr, num_bins=num_bins)


def build_N(fr: Frame, transform_cat: str | None = "gray", rescale: str | None = None) -> Frame:
    """Numeric view = numeric columns + encoded categoricals, rescaled."""
    out = fr
    if transform_cat == "gray":
        out = encode_dummies_reduced(fr)
    elif transform_cat == "one-hot":
        out = encode_onehot(fr)
    elif transform_cat == "one-hot-full":
        out = encode_onehot(fr, use_all_columns=True)
    else:
        out = fr.with_df(fr.df, cat=())
    if rescale:
        out = rescale_numeric(out, rescale)
    return out


def class_index(fr: Frame) -> tuple[DataFrame, DataFrame]:
    """(cls, cnt) and the one-vs-one class pairs (a < b).  The pair table
    is a non-equi self-join of the class table, whose size is checked."""
    cc = fr.df.groupBy(fr.y().alias("cls")).agg(F.count(F.lit(1)).alias("cnt"))
    k = cc.count()
    if k > 10_000:
        raise NotComputable(f"{k} classes: one-vs-one pairs would be too many")
    a, b = cc.alias("a"), cc.alias("b")
    pairs = F.broadcast(a).join(b, F.col("a.cls") < F.col("b.cls")).select(
        F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))
    return cc, pairs


def label_code(df: DataFrame, label: str) -> DataFrame:
    """A numeric label is replaced by its rank among the sorted distinct
    values (distributed ranking + join); a text label is unchanged."""
    from pyspark.sql import types as T
    if not isinstance(df.schema[label].dataType, (T.NumericType,)):
        return df
    lv = sorted_levels(df.select(F.col(label).alias("value")))
    j = df.join(lv.withColumnRenamed("value", "_lv"), F.col(label) == F.col("_lv"), "left")
    return j.withColumn(label, F.col("code")).drop("_lv", "code").select(*df.columns)
