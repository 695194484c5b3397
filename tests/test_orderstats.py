"""Order statistics by distributed ranks against numpy."""

import numpy as np
from pyspark.sql import functions as F

from metaprism.functions.orderstats import at_ranks, modes, quantiles, value_counts


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=20_000), rng.integers(0, 40, 20_000).astype(float)
    b[:7000] = 5.0  # a value with a third of all rows
    df = spark.createDataFrame([(float(x), None if i % 11 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    kept = np.array([y for i, y in enumerate(b) if i % 11])
    qs = [0, 0.1, 0.25, 0.5, 0.75, 0.987, 1]
    got = quantiles(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None).cast("double")}, qs)
    assert np.allclose(got["a"], np.quantile(a, qs), rtol=1e-12) and np.allclose(got["b"], np.quantile(kept, qs)) and got["none"] is None
    ranks = at_ranks(df, {"a": F.col("a")}, lambda n: [0, 17, n - 1, n])["a"]
    assert ranks == {0: np.sort(a)[0], 17: np.sort(a)[17], 19_999: a.max()}


def test_modes(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("x",), ("z",), (None,), (None,), (None,)], "c string")
    assert modes(df, {"c": F.col("c"), "n": F.lit(None).cast("string")}) == {"c": "x", "n": None}
    assert modes(df.limit(0), {"c": F.col("c")}) == {"c": None}


def test_column_features_count_the_rows_once(spark, monkeypatch):
    """Quartiles, deviations, trimmed means and moments share one count of the
    values; they are numpy's, and a constant or empty column stays one."""
    from metaprism.frame import Frame
    from metaprism.operators import statistical as S
    rng = np.random.default_rng(5)
    a, b = rng.gamma(2.0, size=3000), rng.integers(0, 9, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), 2.5, None) for x, y in zip(a, b)], "a double, b double, c double, e double")
    fr, passes = Frame(df=df, num=("a", "b", "c", "e")), []
    monkeypatch.setattr(S, "value_counts", lambda *args: passes.append(1) or value_counts(*args))
    rows = S.column_features(fr).unionByName(S.ft_mad(fr)).unionByName(S.ft_t_mean(fr)).unionByName(S.ft_nr_outliers(fr)).collect()
    got = {(r["feature"], r["attr"]): r["value"] for r in rows}
    assert len(passes) == 1
    for c, v in (("a", a), ("b", b)):
        cut = np.sort(v)[600:-600]
        want = {"mean": v.mean(), "var": v.var(ddof=1), "median": np.median(v), "mad": 1.4826 * np.median(np.abs(v - np.median(v))),
                "t_mean": cut.mean(), "min": v.min(), "max": v.max(), "iq_range": np.subtract(*np.quantile(v, [0.75, 0.25]))}
        assert all(np.isclose(got[f, c], w, rtol=1e-10) for f, w in want.items())
    k = ((a - a.mean()) ** 4).mean() / a.var() ** 2 * (1 - 1 / 3000) ** 2 - 3
    assert np.isclose(got["kurtosis", "a"], k) and np.isclose(got["g_mean", "a"], np.exp(np.log(a).mean()))
    assert got["var", "c"] == 0 and got["kurtosis", "c"] is None and got["mean", "c"] == 2.5 and got["mean", "e"] is None


def test_distinct_values(spark):
    from metaprism.functions.orderstats import distinct_values
    df = spark.createDataFrame([(1, 0.0, "x"), (2, -0.0, "x"), (2, None, None)], "`a.b` long, b double, c string")
    cols = {"a.b": F.col("`a.b`"), "b": F.col("b"), "c": F.col("c"), "none": F.lit(None).cast("string"), "big": F.lit(2 ** 53) + F.col("`a.b`")}
    assert distinct_values(df, cols) == {"a.b": 2, "b": 1, "c": 1, "none": 0, "big": 2}
