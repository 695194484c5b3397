"""Result shaping (U1, U19-U27): fixed schemas, sentinels, vectors, reports,
custom dataset features.  Inputs are small (name, value) tables except for the
custom features, which are single aggregates over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame

# fixed values: sentinels of the reference for errors and infinities
ERROR_VALUE = -1111.0
INF_VALUE = 2222.0
MISSING_TEXT = ("", "na", "n/a", "null", "none")  # fixed values: texts counted as missing
TASKS = ("clasificacion", "regresion", "clustering")  # fixed values: task one-hot order


def sanitise_values(res: DataFrame, col: str = "value") -> DataFrame:
    """null/NaN -> -1111, +-inf -> 2222, else rounded to 2 decimals."""
    v = F.col(col)
    return res.withColumn(col, F.when(v.isNull() | F.isnan(v), F.lit(ERROR_VALUE))
                          .when(F.abs(v) == F.lit(float("inf")), F.lit(INF_VALUE))
                          .otherwise(F.bround(v, 2)))


def drop_sentinels(res: DataFrame, col: str = "value") -> DataFrame:
    """U21."""
    return res.where(~F.col(col).isin(ERROR_VALUE, INF_VALUE))


def fill_fixed_schema(res: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every catalogue name present once; missing -> -1111.
    ``catalogue``: (group, name, pos).  Small-table join."""
    return (catalogue.join(res, "name", "left")
            .select("group", "name", "pos", F.coalesce(F.col("value"), F.lit(ERROR_VALUE)).alias("value")))


def vectorise_features(filled: DataFrame, task: str | None = None) -> DataFrame:
    """One row, the values ordered by catalogue position (+ task one-hot)."""
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    out = filled.agg(vec.alias("vector"))
    if task is not None:
        onehot = F.array(*[F.lit(1.0 if t == task else 0.0) for t in TASKS])
        out = out.select(F.concat("vector", onehot).alias("vector"))
    return out


def column_profile(long_values: DataFrame) -> DataFrame:
    """U23 shaping: per (attr) the single-column features summarised by mean
    (name ``feature.mean``), sanitised and with sentinels dropped."""
    named = long_values.select("attr", F.concat(F.col("feature"), F.lit(".mean")).alias("name"), "value")
    return drop_sentinels(sanitise_values(named))


def count_missing_columns(fr: Frame, cols=None) -> DataFrame:
    """Columns holding a null, or (text columns) a missing-like text."""
    cols = list(cols or fr.attrs)
    flags = []
    for c in cols:
        miss = F.col(c).isNull()
        if c in fr.cat:
            miss = miss | F.lower(F.trim(F.col(c))).isin(*MISSING_TEXT)
        flags.append(F.max(miss.cast("int")).alias(c))
    r = fr.df.agg(*flags)
    return r.select(sum(F.coalesce(F.col(c), F.lit(0)) for c in cols).cast("double").alias("num_columnas_con_valores_faltantes"))


def count_duplicates(fr: Frame, cols=None) -> DataFrame:
    """Rows equal to an earlier row = rows - distinct rows (one
    aggregate with partial aggregation on the tuple)."""
    cols = list(cols or fr.attrs)
    d = fr.df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c"))
    return d.agg((F.sum("c") - F.count(F.lit(1))).cast("double").alias("num_registros_duplicados"))


def dataset_size_kb(fr: Frame, cols=None) -> DataFrame:
    """Size of the table written as header CSV, in KB (one aggregate)."""
    cols = list(cols or fr.df.columns)
    header = len(",".join(cols)) + 1
    line = F.octet_length(F.to_csv(F.struct(*[F.col(c) for c in cols]))) + 1
    return fr.df.agg(((F.sum(line) + F.lit(header)) / 1024.0).alias("peso_kb"))


def format_report(res: DataFrame) -> DataFrame:
    """One text block: per group ``Grupo: g`` then ``feature: value``
    lines (groups and names sorted)."""
    lines = res.groupBy("group").agg(
        F.array_sort(F.collect_list(F.struct("name", F.col("value").cast("string").alias("v")))).alias("items"))
    block = F.concat(F.lit("Grupo: "), F.col("group"), F.lit("\n"),
                     F.concat_ws("", F.transform("items", lambda s: F.concat(s["name"], F.lit(": "), s["v"], F.lit("\n")))))
    return lines.agg(F.concat_ws("", F.array_sort(F.collect_list(F.struct("group", block.alias("b"))))
                                 .getField("b")).alias("report"))


def relative_rank(res: DataFrame, landmarkers: list[str]) -> DataFrame:
    """For each summary, the average rank (ties averaged, ascending
    value) of each landmarker; names ``feature.summary.relative``."""
    parts = F.split(F.col("name"), r"\.")
    lm = (res.withColumn("feature", parts.getItem(0))
          .withColumn("summary", F.expr("array_join(slice(split(name, '\\\\.'), 2, 100), '.')"))
          .where(F.col("feature").isin(landmarkers)))
    w = Window.partitionBy("summary").orderBy("value")  # one row per landmarker per summary
    ties = Window.partitionBy("summary", "value")
    ranked = lm.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    return ranked.select(F.concat(F.col("name"), F.lit(".relative")).alias("name"), F.col("r").cast("double").alias("value"))
