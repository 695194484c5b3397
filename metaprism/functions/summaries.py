"""Summary functions (U2-U14) and the summarise step.

A summary maps the vector of values of one multi-valued feature to one or
more numbers.  Those that partial aggregates determine are expressions over the
``value`` column of the long feature table: one ``groupBy(feature).agg``.
Quantiles and histograms, and features whose rows carry a count, go by counted
values (``_Counted``); some features have a row per data row.  NaN handling
follows numpy: plain forms propagate NaN, ``nan*`` forms ignore it.
"""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import collect_bounded
from .orderstats import quantiles_of_keys, ranged_counts

NAN = float("nan")


def _v() -> Column:
    return F.col("value")


def _has_nan() -> Column:
    return F.max(F.isnan(_v()).cast("int")) == 1


def _ok() -> Column:
    """value without NaN (null otherwise) for the nan* forms."""
    return F.when(~F.isnan(_v()), _v())


def _nan_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def _prop(c: Column) -> Column:
    """numpy propagation: any NaN in the group -> NaN."""
    return F.when(_has_nan(), F.lit(NAN)).otherwise(_nan_if_null(c))


def _sd(x: Column, ddof=1) -> Column:
    return _nan_if_null(F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x))


def _skew(x: Column, method=3) -> Column:
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    if method == 3:
        return _nan_if_null(g1 * F.pow((n - 1.0) / n, 1.5))
    if method == 2:
        return _nan_if_null(F.when(n != 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)).otherwise(g1))
    return _nan_if_null(g1)


def _kurt(x: Column, method=3) -> Column:
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    if method == 3:
        return _nan_if_null((g2 + 3.0) * F.pow(1.0 - 1.0 / n, 2.0) - 3.0)
    if method == 2:
        return _nan_if_null(F.when(n > 3, ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0))).otherwise(g2))
    return _nan_if_null(g2)


def _sum(x: Column) -> Column:
    return F.when(F.count(x) == 0, F.lit(NAN)).otherwise(F.sum(x))


def _powersum(x: Column, p: float, prop: bool) -> Column:
    v = F.sum(F.pow(x, F.lit(float(p))))
    return _prop(v) if prop else _nan_if_null(v)


def _pnorm(x: Column, p: float, prop: bool) -> Column:
    if p < 0:
        return F.lit(NAN)
    v = F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))
    return _prop(v) if prop else _nan_if_null(v)


# name -> builder(**kwargs) -> aggregate Column; the forms that one pass over plain rows determines
ONE_PASS: dict[str, Callable[..., Column]] = {
    "mean": lambda: _nan_if_null(F.avg(_v())),
    "nanmean": lambda: _nan_if_null(F.avg(_ok())),
    "sd": lambda ddof=1: _prop(_sd(_v(), ddof)),
    "nansd": lambda ddof=1: _sd(_ok(), ddof),
    "var": lambda ddof=1: _prop(_nan_if_null(F.var_samp(_v()) if ddof == 1 else F.var_pop(_v()))),
    "nanvar": lambda ddof=1: _nan_if_null(F.var_samp(_ok()) if ddof == 1 else F.var_pop(_ok())),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "nancount": lambda: F.count(_ok()).cast("double"),
    "kurtosis": lambda method=3: _prop(_kurt(_v(), method)),
    "nankurtosis": lambda method=3: _kurt(_ok(), method),
    "max": lambda: _prop(F.max(_v())),
    "nanmax": lambda: _nan_if_null(F.max(_ok())),
    "min": lambda: _prop(F.min(_v())),
    "nanmin": lambda: _nan_if_null(F.min(_ok())),
    "range": lambda: _prop(F.max(_v()) - F.min(_v())),
    "nanrange": lambda: _nan_if_null(F.max(_ok()) - F.min(_ok())),
    "skewness": lambda method=3: _prop(_skew(_v(), method)),
    "nanskewness": lambda method=3: _skew(_ok(), method),
    "sum": lambda: _prop(_sum(_v())),
    "nansum": lambda: _nan_if_null(F.when(F.count(_ok()) == 0, F.lit(NAN)).otherwise(F.sum(_ok()))),
    "powersum": lambda p=2: _powersum(_v(), p, True),
    "pnorm": lambda p=2: _pnorm(_v(), p, True),
    "nanpowersum": lambda p=2: _powersum(_ok(), p, False),
    "nanpnorm": lambda p=2: _pnorm(_ok(), p, False),
}
#: Forms that need ranks or the bounds of all values first.
RANKED = ("histogram", "nanhistogram", "iq_range", "naniq_range", "median", "nanmedian", "quantiles", "nanquantiles")
SUMMARIES = (*ONE_PASS, *RANKED)
QS5 = (0.0, 0.25, 0.5, 0.75, 1.0)


def summary_width(summary: str, bins: int = 10) -> int:
    """How many values a summary has."""
    if summary not in SUMMARIES:
        raise KeyError(summary)
    return {"quantiles": len(QS5), "histogram": bins}.get(summary.removeprefix("nan"), 1)


def _power_column(kind: str, p: float) -> Column:
    return F.pow(F.col("value"), F.lit(float(p))) if kind == "powersum" else F.pow(F.abs("value"), F.lit(float(p)))


class _Counted:
    """What the summaries of counted values (feature, value, n) need, one row a
    feature: sums, bounds and NaN counts in a first aggregate, moments about the
    mean and histogram counts in a second, quantiles by distributed ranks.  Values
    are counted and written once in value order, so no feature meets in one task.
    """

    def __init__(self, vectors: DataFrame, summaries, args: dict):
        plain = [s.removeprefix("nan") for s in summaries]
        n = F.col("n")
        counts = vectors.groupBy("feature", "value").agg(F.sum("n").alias("n")).where(n != 0)
        ranged = ranged_counts(counts, ["feature"])
        x = _ok()
        first = ranged.groupBy("feature").agg(
            F.sum("n").alias("rows"), F.sum(F.when(F.isnan("value"), n)).alias("nans"),
            F.sum(F.when(x.isNotNull(), n)).alias("ok"), F.sum(x * n).alias("total"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        self.first = {r["feature"]: r for r in collect_bounded(first, "features")}
        ok = ranged.where(F.col("value").isNotNull() & ~F.isnan("value"))
        # one row a feature: bounded by collect_bounded above
        centre = F.broadcast(ranged.sparkSession.createDataFrame(
            [(f, r["total"] / r["ok"], r["lo"] - 0.5 * (r["lo"] == r["hi"]), r["hi"] + 0.5 * (r["lo"] == r["hi"]))
             for f, r in self.first.items() if r["ok"]], "feature string, mu double, lo double, hi double"))
        dev = F.col("value") - F.col("mu")
        aggs = [F.sum(n * F.pow(dev, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)]
        self.powers = {s: float(args.get(s, {}).get("p", 2)) for s in summaries if s.endswith(("powersum", "pnorm"))}
        aggs += [F.sum(n * _power_column(s.removeprefix("nan"), p)).alias(s) for s, p in self.powers.items()]
        for s in summaries:
            if s.endswith("histogram"):
                bins = args.get(s, {}).get("bins", 10)
                spot = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
                aggs.append(F.array(*[F.sum(F.when(spot == k, n).otherwise(0)) for k in range(bins)]).alias(s))
        self.second = {r["feature"]: r for r in collect_bounded(ok.join(centre, "feature").groupBy("feature").agg(*aggs), "features")}
        wants_ranks = {"iq_range", "median", "quantiles"} & set(plain)
        self.q = {k[0]: v for k, v in quantiles_of_keys(ok, ["feature"], QS5).items()} if wants_ranks else {}

    def values(self, feature: str, summary: str, ddof: int = 1, method: int = 3, p: float = 2, bins: int = 10) -> list[float]:
        """The values of a summary, several for quantiles and histograms."""
        r = self.first[feature]
        name = summary.removeprefix("nan")
        many = summary_width(summary, bins)
        ok, nans = r["ok"] or 0, r["nans"] or 0
        if name == "count":
            return [float(ok if summary == "nancount" else r["rows"])]
        if not ok or (nans and summary == name) or (name == "pnorm" and p < 0):
            return [NAN] * many
        s, n = self.second[feature], float(ok)
        if name in ("quantiles", "median", "iq_range"):
            q = self.q[feature]
            return {"quantiles": q, "median": [q[2]], "iq_range": [q[3] - q[1]]}[name]
        if name == "histogram":
            return [c / n for c in s[summary]]
        if name in ("powersum", "pnorm"):
            return [s[summary] if name == "powersum" else float(np.power(s[summary], 1.0 / p))]
        if name in ("var", "sd"):
            var = s["m2"] / (n - ddof) if n > ddof else NAN
            return [var if name == "var" else math.sqrt(var)]
        if name in ("skewness", "kurtosis"):
            if s["m2"] == 0:
                return [NAN]
            with np.errstate(all="ignore"):
                return [float(_shape(name, n, *(np.float64(s[k]) / n for k in ("m2", "m3", "m4")), method))]
        return [{"mean": lambda: r["total"] / n, "sum": lambda: r["total"], "min": lambda: r["lo"], "max": lambda: r["hi"],
                 "range": lambda: r["hi"] - r["lo"]}[name]()]


def _shape(name: str, n: float, m2: float, m3: float, m4: float, method: int) -> float:
    if name == "skewness":
        g1 = m3 / m2 ** 1.5
        if method == 3:
            return g1 * ((n - 1.0) / n) ** 1.5
        return g1 * math.sqrt(n * (n - 1.0)) / (n - 2.0) if method == 2 and n != 2 else g1
    g2 = m4 / m2 ** 2 - 3.0
    if method == 3:
        return (g2 + 3.0) * (1.0 - 1.0 / n) ** 2 - 3.0
    return ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)) if method == 2 and n > 3 else g2


def summarise(long_df: DataFrame, summaries=("mean", "sd"), vector_features: set[str] | None = None,
              args: dict | None = None) -> DataFrame:
    """(name, value): ``feature.summary[.i]`` for vector features, the bare
    feature name for scalar ones; sorted by name.

    A column ``n`` of ``long_df`` says how often a row counts.  Without it, and
    without a summary that needs ranks or bounds, one aggregate does; else the
    values of each feature are counted first (``_Counted``).
    """
    args = args or {}
    counted = "n" in long_df.columns
    lf = long_df.select("feature", F.col("value").cast("double").alias("value"),
                        (F.col("n").cast("long") if counted else F.lit(1).cast("long")).alias("n"))
    if vector_features is None:
        vec = lf.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("feature")
        vector_features = {r["feature"] for r in vec.collect()}  # feature names only
    scalars = lf.where(~F.col("feature").isin(list(vector_features)) if vector_features else F.lit(True))
    vectors = lf.where(F.col("feature").isin(list(vector_features)) if vector_features else F.lit(False))
    unknown = [s for s in summaries if s not in SUMMARIES]
    if unknown:
        raise ValueError(f"unknown summaries {unknown}")
    if counted or set(RANKED) & set(summaries):
        table = _Counted(vectors, summaries, args)
        rows = []
        for feature in table.first:
            for s in summaries:
                got = table.values(feature, s, **args.get(s, {}))
                rows += [(f"{feature}.{s}" if len(got) == 1 else f"{feature}.{s}.{i}", float(v)) for i, v in enumerate(got)]
        out = long_df.sparkSession.createDataFrame(rows, "name string, value double")
    else:
        aggs = [ONE_PASS[s](**args.get(s, {})).alias(f"s{i}") for i, s in enumerate(summaries)]
        items = [F.struct(F.concat(F.col("feature"), F.lit("." + s)).alias("name"), F.col(f"s{i}").cast("double").alias("value"))
                 for i, s in enumerate(summaries)]
        out = vectors.groupBy("feature").agg(*aggs).select(F.inline(F.array(*items)))
    return out.unionByName(scalars.select(F.col("feature").alias("name"), "value")).orderBy("name")
