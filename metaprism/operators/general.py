"""General meta-features (G1-G11): sizes, type counts and class shares.

Everything comes from one aggregate over the data plus the column roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, unpivot
from ..functions.numeric import safe_div


def _n(fr: Frame) -> DataFrame:
    """One-row frame with the (memoised) row count: the size features share a
    single count action instead of one scan each."""
    return fr.spark.range(1).select(F.lit(float(fr.count())).alias("n"))


def ft_nr_inst(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("nr_inst", F.col("n"))])


def ft_nr_attr(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("nr_attr", F.lit(float(len(fr.attrs))))])


def ft_nr_num(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("nr_num", F.lit(float(len(fr.num))))])


def ft_nr_cat(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("nr_cat", F.lit(float(len(fr.cat))))])


def ft_attr_to_inst(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("attr_to_inst", safe_div(F.lit(float(len(fr.attrs))), F.col("n")))])


def ft_inst_to_attr(fr: Frame) -> DataFrame:
    return unpivot(_n(fr), [entry("inst_to_attr", safe_div(F.col("n"), F.lit(float(len(fr.attrs)))))])


def ft_cat_to_num(fr: Frame) -> DataFrame:
    d, c = len(fr.attrs), len(fr.cat)
    v = float("nan") if d == c else c / (d - c)
    return unpivot(_n(fr), [entry("cat_to_num", F.lit(v))])


def ft_num_to_cat(fr: Frame) -> DataFrame:
    d, c = len(fr.attrs), len(fr.cat)
    v = float("nan") if c == 0 else (d - c) / c
    return unpivot(_n(fr), [entry("num_to_cat", F.lit(v))])


def ft_nr_bin(fr: Frame) -> DataFrame:
    """Columns with exactly two distinct non-null values.

    Two cheap codegen passes instead of one count-distinct per column:
    min/max (a one-row fit), then a count of values equal to neither.
    """
    cols = list(fr.attrs)
    if not cols:
        return unpivot(_n(fr), [entry("nr_bin", F.lit(0.0))])
    mm = fr.df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    others = fr.df.agg(*[
        F.count_if((F.col(c) != F.lit(mm[f"lo{i}"])) & (F.col(c) != F.lit(mm[f"hi{i}"]))).alias(f"o{i}")
        if mm[f"lo{i}"] is not None else F.lit(1).alias(f"o{i}")
        for i, c in enumerate(cols)
    ])
    bins = sum(
        (F.col(f"o{i}") == 0).cast("double") if mm[f"lo{i}"] != mm[f"hi{i}"] else F.lit(0.0)
        for i in range(len(cols))
    )
    return unpivot(others, [entry("nr_bin", bins)])


def class_counts(fr: Frame) -> DataFrame:
    """(cls, cnt) per distinct label value: the class index of T9."""
    return fr.df.groupBy(fr.y().alias("cls")).agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def ft_nr_class(fr: Frame) -> DataFrame:
    k = fr.df.agg(F.count_distinct(fr.y()).cast("double").alias("k"))
    return unpivot(k, [entry("nr_class", F.col("k"))])


def ft_freq_class(fr: Frame) -> DataFrame:
    n = float(fr.count())
    return unpivot(class_counts(fr), [entry("freq_class", F.col("cnt") / F.lit(n), cls=F.col("cls"))])


FEATURES = {
    "attr_to_inst": ft_attr_to_inst, "cat_to_num": ft_cat_to_num,
    "freq_class": ft_freq_class, "inst_to_attr": ft_inst_to_attr,
    "nr_attr": ft_nr_attr, "nr_bin": ft_nr_bin, "nr_cat": ft_nr_cat,
    "nr_class": ft_nr_class, "nr_inst": ft_nr_inst, "nr_num": ft_nr_num,
    "num_to_cat": ft_num_to_cat,
}
NEEDS_LABEL = {"freq_class", "nr_class"}
