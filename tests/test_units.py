"""Operator unit tests on small literal tables, against numpy formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame, LONG_SCHEMA
from metaprism.functions.summaries import summarise
from metaprism.operators import evaluation as V


def _long(spark, values, feature="f"):
    rows = [(feature, None, None, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LONG_SCHEMA)


def _summ(spark, values, names, **args):
    out = summarise(_long(spark, values), names, vector_features={"f"}, args=args).collect()
    return {r["name"]: r["value"] for r in out}


def test_summaries_on_one_to_ten(spark):
    x = np.arange(1.0, 11.0)
    got = _summ(spark, list(x), ("mean", "sd", "var", "count", "min", "max", "median", "range", "sum",
                                 "iq_range", "powersum", "pnorm", "quantiles", "histogram", "skewness", "kurtosis"))
    n = len(x)
    m2, m3, m4 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean(), ((x - x.mean()) ** 4).mean()
    want = {
        "f.mean": x.mean(), "f.sd": x.std(ddof=1), "f.var": x.var(ddof=1), "f.count": 10.0, "f.min": 1.0,
        "f.max": 10.0, "f.median": 5.5, "f.range": 9.0, "f.sum": 55.0,
        "f.iq_range": np.percentile(x, 75) - np.percentile(x, 25), "f.powersum": (x ** 2).sum(),
        "f.pnorm": np.linalg.norm(x), "f.skewness": m3 / m2 ** 1.5 * ((n - 1) / n) ** 1.5,
        "f.kurtosis": (m4 / m2 ** 2) * (1 - 1 / n) ** 2 - 3,
    }
    for i, q in enumerate(np.quantile(x, [0, 0.25, 0.5, 0.75, 1])):
        want[f"f.quantiles.{i}"] = q
    for i, h in enumerate(np.histogram(x, bins=10)[0] / 10.0):
        want[f"f.histogram.{i}"] = h
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def test_nan_forms(spark):
    vals = [1.0, 2.0, float("nan"), 4.0]
    got = _summ(spark, vals, ("mean", "nanmean", "sd", "nansd", "nancount", "nanmax"))
    assert math.isnan(got["f.mean"]) and math.isnan(got["f.sd"])
    assert got["f.nanmean"] == pytest.approx(7.0 / 3)
    assert got["f.nansd"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert got["f.nancount"] == 3.0 and got["f.nanmax"] == 4.0


def test_single_value_sd_is_nan(spark):
    got = _summ(spark, [3.0], ("sd", "var"))
    assert math.isnan(got["f.sd"]) and math.isnan(got["f.var"])


def test_classification_scores(spark):
    y = [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    p = [0, 1, 0, 1, 1, 2, 2, 2, 0, 2]
    df = spark.createDataFrame(list(zip(y, p)), "y int, pred int")
    m = V.classification_metrics(df).first()
    ya, pa = np.array(y), np.array(p)
    labels = np.unique(np.concatenate([ya, pa]))
    sup = np.array([(ya == c).sum() for c in labels])
    prec = np.array([((pa == c) & (ya == c)).sum() / max((pa == c).sum(), 1) for c in labels])
    rec = np.array([((pa == c) & (ya == c)).sum() / max((ya == c).sum(), 1) for c in labels])
    f1 = np.where(prec + rec > 0, 2 * prec * rec / np.where(prec + rec > 0, prec + rec, 1), 0)
    assert m["accuracy"] == pytest.approx((ya == pa).mean())
    assert m["balanced_accuracy"] == pytest.approx(rec.mean())
    assert m["precision"] == pytest.approx((sup * prec).sum() / len(y))
    assert m["recall"] == pytest.approx((sup * rec).sum() / len(y))
    assert m["f1"] == pytest.approx((sup * f1).sum() / len(y))


def test_regression_scores(spark):
    y = np.array([3.0, -0.5, 2.0, 7.0, 4.2])
    p = np.array([2.5, 0.0, 2.0, 8.0, 3.9])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, pred double")
    m = V.regression_metrics(df).first()
    e = y - p
    assert m["mae"] == pytest.approx(np.abs(e).mean())
    assert m["mse"] == pytest.approx((e ** 2).mean())
    assert m["rmse"] == pytest.approx(math.sqrt((e ** 2).mean()))
    assert m["r2"] == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["medae"] == pytest.approx(np.median(np.abs(e)))
    assert m["ev"] == pytest.approx(1 - e.var() / y.var())


def test_itemset_toy(spark):
    from metaprism.operators import itemset as J
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("a", "x")]
    df = spark.createDataFrame(rows, "c1 string, c2 string")
    fr = Frame(df=df, num=(), cat=("c1", "c2"))
    one = {r["attr"]: r["value"] for r in J.ft_one_itemset(fr).collect()}
    assert one == {"c1=a": 0.6, "c1=b": 0.4, "c2=x": 0.8, "c2=y": 0.2}
    two = {r["attr"]: r["value"] for r in J.ft_two_itemset(fr).collect()}
    # XOR share: rows where exactly one of (c1 = a), (c2 = x) holds
    assert two["c1|c2:a|x"] == pytest.approx(3 / 5)  # rows 2, 3, 4
    assert two["c1|c2:b|y"] == pytest.approx(3 / 5)


def test_codes_count_edges_below_without_comparing_each(spark):
    """Codes at, between and beyond edges, of no value, NaN, infinities and both
    zeros; the plan does not hold a comparison an edge."""
    from metaprism.operators.encoding import discretise_equal_freq
    edges = {"a": [-math.inf, -2.5, 0.0, *[i / 7 for i in range(1, 900)], math.inf], "c": [], "d": [math.inf], "e": [1.0]}
    values = [None, math.nan, math.inf, -math.inf, -3.0, -2.5, -0.0, 0.0, 1 / 7, 0.2, 57.0, 128.0, 1e9]
    df = spark.createDataFrame([(i, v, v, v, v) for i, v in enumerate(values)], "i int, a double, c double, d double, e double")
    out = discretise_equal_freq(Frame(df=df, num=("a", "c", "d", "e")), edges=edges)
    assert out.num == () and out.cat == ("a", "c", "d", "e")
    assert out.df.columns == df.columns and all(t == "int" for _, t in out.df.dtypes)
    above = lambda x, e: math.isnan(x) and not math.isnan(e) or x > e  # noqa: E731 - NaN is the greatest
    for r in out.df.collect():
        v = values[r["i"]]
        for c, es in edges.items():
            want = 0 if not es else None if v is None else sum(above(v, e) for e in es)
            assert r[c] == want, (c, v)
    assert out.df._jdf.queryExecution().analyzed().toString().count(" > ") < 20
