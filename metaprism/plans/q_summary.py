"""Registered queries: summary functions (U2-U15) over a feature vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.numeric import sig, sql_sig
from ..functions.summaries import summarise
from ..operators import itemset as J
from ..operators import statistical as S
from ..session import read_table
from ..sources.tables import lineitem_frame
from .q_profile import col_features_union
from .registry import query, row, union
from .sqlbind import LI_CTE

ALL_COL = list(S.COLUMN_FEATURES)
PLAIN = ["mean", "sd", "var", "count", "histogram", "iq_range", "kurtosis", "max", "median", "min",
         "quantiles", "range", "skewness", "sum", "powersum", "pnorm"]
NANS = ["nanmean", "nansd", "nanvar", "nancount", "nanhistogram", "naniq_range", "nankurtosis", "nanmax",
        "nanmedian", "nanmin", "nanquantiles", "nanrange", "nanskewness", "nansum", "nanpowersum", "nanpnorm"]


def _summary_sql(lf: str | None = None) -> str:
    """Every summary of the long rows that ``lf`` selects from ``li``."""
    g = "FROM lf GROUP BY feature"
    mo = ("FROM lf JOIN (SELECT feature, avg(value) AS mu FROM lf GROUP BY feature) AS m USING (feature) "
          "GROUP BY feature")
    parts = []

    def add(name, expr, src=g):
        parts.append(f"SELECT feature || '.{name}' AS name, CAST({expr} AS DOUBLE) AS value {src}")

    for pre in ("", "nan"):
        add(pre + "mean", "avg(value)")
        add(pre + "sd", "stddev_samp(value)")
        add(pre + "var", "var_samp(value)")
        add(pre + "count", "count(*)")
        for k in range(10):
            add(f"{pre}histogram.{k}",
                f"count(*) FILTER (WHERE least(floor((value - lo) / (hi - lo) * 10), 9) = {k}) * 1.0 / count(*)",
                "FROM lf JOIN mm USING (feature) GROUP BY feature")
        add(pre + "iq_range", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")
        add(pre + "kurtosis", "(count(*) * sum(power(value - mu, 4)) / power(sum(power(value - mu, 2)), 2)) "
                              "* power(1 - 1.0 / count(*), 2) - 3", mo)
        add(pre + "skewness", "sqrt(count(*)) * sum(power(value - mu, 3)) / power(sum(power(value - mu, 2)), 1.5) "
                              "* power((count(*) - 1.0) / count(*), 1.5)", mo)
        add(pre + "max", "max(value)")
        add(pre + "median", "quantile_cont(value, 0.5)")
        add(pre + "min", "min(value)")
        for k, q in enumerate([0.0, 0.25, 0.5, 0.75, 1.0]):
            add(f"{pre}quantiles.{k}", f"quantile_cont(value, {q})")
        add(pre + "range", "max(value) - min(value)")
        add(pre + "sum", "sum(value)")
        add(pre + "powersum", "sum(power(value, 2))")
        add(pre + "pnorm", "sqrt(sum(power(abs(value), 2)))")
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH {LI_CTE}, lf AS ({lf or col_features_union(ALL_COL)}), "
            "mm AS (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, "
            "CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM lf GROUP BY feature) "
            f"SELECT name, {sql_sig('value')} AS value FROM ({body}) AS s")


@query("summary_functions", _summary_sql(), group="summary")
def q_summary_functions(spark, sf_dir):
    long = S.column_features(lineitem_frame(spark, sf_dir), ALL_COL)
    out = summarise(long, PLAIN + NANS, vector_features=set(ALL_COL))
    return out.select("name", sig(F.col("value")).alias("value"))


ITEM_COLS = ("l_partkey", "l_suppkey", "l_quantity")


def _item_grid_sql() -> str:
    """All cells of all level pairs, absent ones included, as the features define them."""
    count = lambda cols, n: f"(SELECT {cols}, count(*) AS {n} FROM li GROUP BY ALL)"
    return union([
        row("two_itemset", "(xs.na + ys.nb - 2.0 * coalesce(p.nab, 0)) / (SELECT count(*) FROM li)", idx=0,
            src=f"FROM {count(f'{a} AS va', 'na')} AS xs CROSS JOIN {count(f'{b} AS vb', 'nb')} AS ys "
                f"LEFT JOIN {count(f'{a} AS va, {b} AS vb', 'nab')} AS p ON p.va = xs.va AND p.vb = ys.vb")
        for i, a in enumerate(ITEM_COLS) for b in ITEM_COLS[i + 1:]])


@query("itemset_summaries", _summary_sql(_item_grid_sql()), group="summary")
def q_itemset_summaries(spark, sf_dir):
    """Summaries of the two-item features of columns with many levels, without
    the level grid that the SQL has."""
    li = read_table(spark, sf_dir, "lineitem").select(*ITEM_COLS)
    counts = J.two_itemset_counts(Frame(df=li, cat=ITEM_COLS))
    out = summarise(counts, PLAIN + NANS, vector_features={"two_itemset"})
    return out.select("name", sig(F.col("value")).alias("value"))


@query("extract_default", group="extract")
def q_extract_default(spark, sf_dir):
    """The reference's default call: general, statistical and information
    theory groups summarised by mean and sd, (name, value) sorted by name."""
    from .extract import extract
    out = extract(lineitem_frame(spark, sf_dir))
    return out.select("name", sig(F.col("value")).alias("value"))


@query("extract_all_groups", group="extract")
def q_extract_all(spark, sf_dir):
    """Every group (incl. clustering, complexity, concept, item sets,
    landmarking and tree shape) on the embeddings table."""
    from ..sources.tables import embeddings_frame
    from .extract import extract
    out = extract(embeddings_frame(spark, sf_dir), groups="all")
    return out.select("name", sig(F.col("value")).alias("value"))
