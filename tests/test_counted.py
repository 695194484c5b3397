"""Summaries of counted values, order statistics of groups, and item sets
without absent cells, against numpy and the full grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame, NotComputable
from metaprism.functions.orderstats import group_quantiles
from metaprism.functions.summaries import RANKED, SUMMARIES, summarise, summary_width
from metaprism.operators import clustering, itemset, statistical
from metaprism.plans import extract as X

NAN = float("nan")
MOMENTS = tuple(s for s in SUMMARIES if s not in RANKED)


def values(df):
    return {r["name"]: r["value"] for r in df.collect()}


def same(got, want, rel=1e-9):
    assert got.keys() == want.keys()
    for k in want:
        a, b = got[k], want[k]
        assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=rel, abs=1e-12), (k, a, b)


def long_rows(spark, groups):
    rows = [(f, None if v is None else float(v)) for f, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "feature string, value double")


GROUPS = {
    "long": list(np.random.default_rng(3).normal(5, 2, 3000).round(2)),
    "tied": [1.0] * 900 + [2.0] * 100,
    "nan": [1.0, 2.0, NAN, 4.0, 9.0],
    "null": [1.0, None, 3.0],
    "one": [7.5],
    "only_nan": [NAN, NAN],
    "only_null": [None, None],
}


def test_counted_and_one_pass_agree(spark):
    lf = long_rows(spark, GROUPS)
    plain = values(summarise(lf, MOMENTS, set(GROUPS)))
    counted = values(summarise(lf.groupBy("feature", "value").agg(F.count("*").alias("n")), MOMENTS, set(GROUPS)))
    same(counted, plain)
    # repeated values in rows of their own and as counts
    rows = lf.withColumn("n", F.lit(1)).unionByName(lf.withColumn("n", F.lit(2)))
    thrice = lf.unionByName(lf).unionByName(lf)
    same(values(summarise(rows, SUMMARIES, set(GROUPS))), values(summarise(thrice, SUMMARIES, set(GROUPS))))


def test_options_of_both_paths_agree(spark):
    lf = long_rows(spark, GROUPS)
    for method in (1, 2, 3):
        args = {"kurtosis": {"method": method}, "nanskewness": {"method": method}, "sd": {"ddof": 0}, "var": {"ddof": 0},
                "pnorm": {"p": 3}, "nanpowersum": {"p": 1.5}}
        plain = values(summarise(lf, tuple(args), set(GROUPS), args))
        same(values(summarise(lf.withColumn("n", F.lit(1)), tuple(args), set(GROUPS), args)), plain)


def test_ranked_summaries_equal_numpy(spark):
    got = values(summarise(long_rows(spark, GROUPS), RANKED, set(GROUPS), {"histogram": {"bins": 7}}))
    for f, vs in GROUPS.items():
        x = np.array([v for v in vs if v is not None], float)
        ok = x[~np.isnan(x)]
        for pre, y in (("", x if not np.isnan(x).any() else ok[:0]), ("nan", ok)):
            bins = 7 if pre == "" else 10
            q = np.quantile(y, [0, .25, .5, .75, 1]) if len(y) else np.full(5, NAN)
            h = np.histogram(y, bins)[0] / len(y) if len(y) else np.full(bins, NAN)
            want = {f"{f}.{pre}median": q[2], f"{f}.{pre}iq_range": q[3] - q[1],
                    **{f"{f}.{pre}quantiles.{i}": v for i, v in enumerate(q)},
                    **{f"{f}.{pre}histogram.{i}": v for i, v in enumerate(h)}}
            same({k: got[k] for k in want}, want)


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "feature string, value double")
    assert summarise(none, ("mean", "median"), {"f"}).collect() == []
    assert summarise(none, ("mean",), {"f"}).collect() == []
    with pytest.raises(ValueError):
        summarise(none, ("nosuch",), {"f"})
    assert [summary_width(s) for s in ("mean", "quantiles", "nanhistogram")] == [1, 5, 10]


def grouped(spark):
    rng = np.random.default_rng(7)
    cls = ["hot"] * 700 + ["b"] * 200 + [None] * 50 + ["empty"] * 3
    rows = [(c, None if c == "empty" else float(x), float(i % 9)) for i, (c, x) in enumerate(zip(cls, rng.normal(size=len(cls))))]
    return rows, spark.createDataFrame(rows, "y string, u double, v double")


def test_group_quantiles(spark):
    rows, df = grouped(spark)
    got = {r["grp"]: r for r in group_quantiles(df, {"u": F.col("u"), "v": F.col("v")}, F.col("y"), [0.1, 0.5]).collect()}
    assert set(got) == {"hot", "b", None, "empty"} and got["empty"]["u"] is None
    for g, r in got.items():
        for i, c in ((1, "u"), (2, "v")):
            x = [t[i] for t in rows if t[0] == g and t[i] is not None]
            assert not x or r[c] == pytest.approx(list(np.quantile(x, [0.1, 0.5])))


def test_class_quartiles_and_median_centres(spark):
    rows, df = grouped(spark)
    fr = Frame(df=df, num=("u", "v"), label="y")
    long = statistical.column_features(fr, ["median", "iq_range", "mean"], by_class=True).collect()
    got = {(r["feature"], r["cls"], r["attr"]): r["value"] for r in long}
    centre = {r["cls"]: r for r in clustering.class_centroids(fr, "median").collect()}
    for g in ("hot", "b", None):
        for i, c in ((1, "u"), (2, "v")):
            x = np.array([t[i] for t in rows if t[0] == g])
            assert got["median", g, c] == pytest.approx(np.median(x)) == centre[g][f"c{i - 1}"]
            assert got["iq_range", g, c] == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25))
            assert got["mean", g, c] == pytest.approx(x.mean())
    assert got["median", "empty", "u"] is None and centre["empty"]["c0"] is None and centre["empty"]["cnt"] == 3
    with pytest.raises(ValueError):
        clustering.class_centroids(fr, "mode")


def items(spark, n=600):
    rng = np.random.default_rng(11)
    rows = [(f"a{min(int(rng.exponential(3)), 40)}", None if i % 17 == 0 else f"b{i % 31}", "c" + "xyz"[i % 3]) for i in range(n)]
    return Frame(df=spark.createDataFrame(rows, "p string, q string, r string"), cat=("p", "q", "r"))


def test_two_itemset_counts_equal_the_grid(spark):
    fr = items(spark)
    grid = itemset.ft_two_itemset(fr).groupBy("value").count().collect()
    found = itemset.two_itemset_counts(fr).collect()
    assert {round(r["value"], 12): r["n"] for r in found} == {round(r["value"], 12): r["count"] for r in grid}
    assert len(found) < sum(r["n"] for r in found) / 5
    with pytest.raises(NotComputable):
        itemset.two_itemset_counts(Frame(df=fr.df, cat=("p",)))


def test_extraction_summarises_item_sets_without_the_grid(spark):
    fr = items(spark)
    wanted = ("mean", "sd", "skewness", "kurtosis", "median", "quantiles", "histogram", "count", "sum", "min", "max")
    full = X.feature_table(fr, ("itemset",))
    assert set(full.columns) >= {"attr", "value"}
    same(values(X.extract(fr, ("itemset",), summary=wanted)), values(summarise(full, wanted, {"one_itemset", "two_itemset"})))
