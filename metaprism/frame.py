"""The dataset handle every operator takes, and the long result form.

A ``Frame`` is one DataFrame plus the roles of its columns: numeric
attributes ``num``, categorical attributes ``cat``, an optional label and an
optional stable row key.  Nothing is collected; the roles are metadata.

Feature operators return the long form ``(feature, attr, cls, idx, value)``.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field, replace
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import ensure_checkpoint_dir

LONG_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("attr", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


class NotComputable(ValueError):
    """A feature has no value on these data (too few rows, levels or classes),
    or they exceed a stated size."""


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    num: tuple[str, ...] = ()
    cat: tuple[str, ...] = ()
    label: str | None = None
    row_id: str | None = None
    name: str = "dataset"
    options: dict = field(default_factory=dict, compare=False)

    @property
    def attrs(self) -> tuple[str, ...]:
        order = {c: i for i, c in enumerate(self.df.columns)}
        return tuple(sorted(self.num + self.cat, key=lambda c: order.get(c, 1 << 30)))

    @property
    def spark(self):
        return self.df.sparkSession

    def with_df(self, df: DataFrame, **kw) -> "Frame":
        # what was computed of the old rows does not carry over
        return replace(self, df=df, **({"options": {}} | kw))

    def memo(self, key, make):
        """``make()`` once per Frame and key, also when several features ask
        for it at the same time."""
        with self.options.setdefault(("lock", key), threading.RLock()):
            if key not in self.options:
                self.options[key] = make()
            return self.options[key]

    def count(self) -> int:
        """Row count, computed once per Frame (one aggregate action)."""
        return self.memo("rows", self.df.count)

    def y(self) -> Column:
        if self.label is None:
            raise NotComputable("this feature needs a label")
        return F.col(self.label).cast("string")


def frame(df: DataFrame, label: str | None = None, num: Sequence[str] | None = None,
          cat: Sequence[str] | None = None, row_id: str | None = None,
          name: str = "dataset") -> Frame:
    """Build a Frame; column kinds default to the schema (T1 'auto')."""
    skip = {label, row_id}
    if num is None or cat is None:
        a_num, a_cat = infer_kinds(df, exclude=skip)
        num = a_num if num is None else num
        cat = a_cat if cat is None else cat
    return Frame(df=df, num=tuple(num), cat=tuple(cat), label=label, row_id=row_id, name=name)


ROW_KEY = "_row"


def keyed(fr: Frame, integral: bool = False) -> Frame:
    """``fr`` itself if it has a row key (``integral``: a whole number), else
    with ``ROW_KEY``: the rows' numbers in their order, written once, so that
    every reader sees the same ones.  Repeated rows are rows of their own."""
    if fr.row_id is not None and (not integral or isinstance(fr.df.schema[fr.row_id].dataType, T.IntegralType)):
        return fr

    def number() -> Frame:
        ensure_checkpoint_dir(fr.spark)
        return fr.with_df(fr.df.withColumn(ROW_KEY, F.monotonically_increasing_id()).checkpoint(eager=True), row_id=ROW_KEY)
    return fr.memo("keyed", number)


def infer_kinds(df: DataFrame, exclude: Iterable[str | None] = ()) -> tuple[list[str], list[str]]:
    ex = set(exclude)
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in ex:
            continue
        if isinstance(f.dataType, NUMERIC_TYPES):
            num.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
    return num, cat


def entry(feature: str, value: Column, attr: str | Column | None = None,
          cls: str | Column | None = None, idx: int | Column | None = None) -> Column:
    """One long-form struct; ``inline`` of an array of these unpivots a row."""
    def lit_or(c, typ):
        if isinstance(c, Column):
            return c.cast(typ)
        return F.lit(c).cast(typ)
    return F.struct(
        F.lit(feature).alias("feature"),
        lit_or(attr, "string").alias("attr"),
        lit_or(cls, "string").alias("cls"),
        lit_or(0 if idx is None else idx, "int").alias("idx"),
        value.cast("double").alias("value"),
    )


def unpivot(df: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn each input row into ``len(entries)`` long rows."""
    if not entries:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    return df.select(F.inline(F.array(*entries)))


def empty_long(spark) -> DataFrame:
    return spark.createDataFrame([], LONG_SCHEMA)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


MAX_GROUPS = 100_000


def collect_bounded(df: DataFrame, what: str, limit: int = MAX_GROUPS) -> list:
    """Collect a small aggregate (one row per class / level / column) after
    checking its size: at most ``limit`` rows are fetched, and more than
    ``limit`` raises instead of silently truncating."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise NotComputable(f"more than {limit} {what}: too many to bring to the driver")
    return rows
