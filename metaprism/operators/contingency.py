"""Contingency kernel: unpivot categorical columns, count (attr, value, y).

The unpivot is a ``Generate`` pipelined into the partial hash aggregate, so
only distinct (attr, value, y) cells cross the shuffle; the result has
sum(levels) x classes rows, independent of the row count.  Cells absent from
the data matter for the smoothed entropy and XOR features; they are handled
in closed form (count of absent cells) or by joining small level tables, never
by materialising a row x level matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, NotComputable


def long_values(fr: Frame, cols=None, with_label: bool = True) -> DataFrame:
    """(attr, value[, y]) for every non-null cell of the categorical columns."""
    cols = list(cols if cols is not None else fr.cat)
    items = [F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value")) for c in cols]
    sel = [F.inline(F.array(*items))]
    if with_label:
        sel.append(fr.y().alias("y"))
    out = fr.df.select(*sel).where(F.col("value").isNotNull())
    if with_label:
        out = out.where(F.col("y").isNotNull())
    return out


def attr_class_counts(fr: Frame, cols=None) -> DataFrame:
    """(attr, value, y, cnt) - the contingency table of every column with y."""
    return (long_values(fr, cols).groupBy("attr", "value", "y")
            .agg(F.count(F.lit(1)).cast("double").alias("cnt")))


def value_counts(fr: Frame, cols=None) -> DataFrame:
    """(attr, value, cnt)."""
    return (long_values(fr, cols, with_label=False).groupBy("attr", "value")
            .agg(F.count(F.lit(1)).cast("double").alias("cnt")))


def pair_counts(fr: Frame, cols=None) -> DataFrame:
    """(a, b, va, vb, cnt) for every unordered column pair a < b (column order).

    Each row emits d(d-1)/2 pair cells, combined map-side before the shuffle.
    """
    cols = list(cols if cols is not None else fr.cat)
    items = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                  F.col(a).cast("string").alias("va"),
                                  F.col(b).cast("string").alias("vb")))
    if not items:
        raise NotComputable("need at least two categorical columns")
    return (fr.df.select(F.inline(F.array(*items)))
            .where(F.col("va").isNotNull() & F.col("vb").isNotNull())
            .groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).cast("double").alias("cnt")))
