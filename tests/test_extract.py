"""Extraction on the two views, failing features, and known values of the iris
measurements."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.plans import extract as X


def mixed(spark):
    rows = [(float(i % 17), float((i * 7) % 23), "abc"[i % 3], "uv"[i % 2], "yn"[(i // 2) % 2]) for i in range(400)]
    return Frame(df=spark.createDataFrame(rows, "p double, q double, `c.1` string, d string, y string").withColumnRenamed("c.1", "c"),
                 num=("p", "q"), cat=("c", "d"), label="y")


def values(df):
    return {r["name"]: r["value"] for r in df.collect()}


def test_views(spark):
    fr = mixed(spark)
    got = values(X.extract(fr, ("statistical", "info-theory", "itemset"), ["mean", "attr_ent", "one_itemset"], summary=("count", "mean")))
    # p, q, three columns of c (the first text column keeps all levels) and one of d; four columns as categories
    assert got["mean.count"] == 6 and got["attr_ent.count"] == 4
    raw = values(X.extract(fr, ("statistical", "info-theory"), ["mean", "attr_ent"], summary=("count",), transform_num=False, transform_cat=None))
    assert raw["mean.count"] == 2 and raw["attr_ent.count"] == 2
    scaled = values(X.extract(fr, ("statistical",), ["max", "min"], summary=("max", "min"), rescale="min-max"))
    assert scaled["max.max"] == 1 and scaled["min.min"] == 0


def test_a_failing_feature_is_nan(spark, monkeypatch):
    def broken(fr):
        raise ArithmeticError("no")
    monkeypatch.setitem(X.general.FEATURES, "nr_inst", broken)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = values(X.extract(mixed(spark), ("general",), ["nr_inst", "nr_class"]))
    assert math.isnan(got["nr_inst"]) and got["nr_class"] == 2


def test_other_errors_are_raised(spark, monkeypatch):
    def broken(fr):
        raise KeyError("a bug")
    monkeypatch.setitem(X.general.FEATURES, "nr_inst", broken)
    with pytest.raises(KeyError):
        X.extract(mixed(spark), ("general",), ["nr_inst", "nr_class"])


def test_row_count_follows_the_rows(spark):
    fr = mixed(spark)
    assert fr.count() == 400
    assert fr.with_df(fr.df.where(F.col("p") < 3)).count() == fr.df.where("p < 3").count()


def test_relative_ranks(spark):
    fr = mixed(spark)
    names = ["one_nn", "naive_bayes"]
    both = values(X.extract(fr, ("landmarking", "relative"), names, summary=("mean",)))
    assert set(both) == {f"{n}.mean{e}" for n in names for e in ("", ".relative")}
    assert all(math.isfinite(v) for v in both.values())
    assert sorted(both[f"{n}.mean.relative"] for n in names) in ([1.0, 2.0], [1.5, 1.5])
    assert (both["one_nn.mean"] > both["naive_bayes.mean"]) == (both["one_nn.mean.relative"] > both["naive_bayes.mean.relative"])
    only = X.extract(fr, ("relative",), names, summary=("mean",))
    assert set(values(only)) == {f"{n}.mean.relative" for n in names}
    assert X.parse_by_group(only, ["landmarking"]).count() == 0 and X.parse_by_group(only, ["relative"]).count() == 2
