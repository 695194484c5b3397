"""Rank-based normality tests against plain numpy over the sorted column."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from metaprism.frame import frame
from metaprism.functions import normality as N
from metaprism.operators import statistical as S
from pyspark.sql import functions as F

ND = NormalDist()


def _plain(x):
    """W and A2 by loops over the sorted values, one weight a value."""
    x = np.sort(np.asarray(x, dtype=float))
    n, m, sd = len(x), np.mean(x), np.std(x, ddof=1)
    z = [(v - m) / sd for v in x]
    a2 = -n - sum((2 * i + 1) * (math.log(0.5 * math.erfc(-z[i] / math.sqrt(2))) + math.log(0.5 * math.erfc(z[n - 1 - i] / math.sqrt(2))))
                  for i in range(n)) / n
    q = np.array([ND.inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)])
    ss, u = (q * q).sum(), 1 / math.sqrt(n)
    w = q.copy()
    w[-1] = q[-1] / math.sqrt(ss) + np.polyval(N.ROYSTON_LAST[::-1], u)
    ends = 1
    if n > 5:
        w[-2], ends = q[-2] / math.sqrt(ss) + np.polyval(N.ROYSTON_NEXT[::-1], u), 2
    rest = (ss - 2 * (q[-ends:] ** 2).sum()) / (1 - 2 * (w[-ends:] ** 2).sum())
    w[ends:-ends] /= math.sqrt(rest)
    w[:ends] = -w[-ends:][::-1]
    return (w * x).sum() ** 2 / ((x - m) ** 2).sum(), a2


@pytest.mark.parametrize("n", [4, 5, 6, 11, 40, 5000])
def test_statistics_as_over_sorted_values(spark, n):
    rng = np.random.default_rng(n)
    data = {"normal": rng.normal(3, 2, n), "skew": rng.exponential(size=n), "ties": np.round(rng.normal(size=n), 1),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 3, n)), "bits": np.arange(n) % 2 * 1.0}
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())] + [(None,) * len(data)] * 3
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(3)
    got = N.rank_statistics(df, {c: F.col(c) for c in data})
    for c, x in data.items():
        w, a2 = _plain(x)
        assert got[c]["n"] == n
        assert got[c]["w"] == pytest.approx(w, rel=1e-8), c
        assert got[c]["a2"] == pytest.approx(a2, rel=1e-8, abs=1e-8), c


@pytest.mark.parametrize("a, b, n", [(1, 20_000, 20_000), (600, 9_000, 20_000), (2, 700, 5_000), (4_000, 19_999, 20_000), (9_000, 11_100, 20_000)])
def test_long_runs_of_equal_values(a, b, n):
    z = N.scores(np.arange(a, b + 1), n)
    assert N._run_sum(a, b, n) == pytest.approx(z.sum(), rel=1e-9, abs=1e-8)
    assert N._run_sum(a, b, n, square=True) == pytest.approx((z * z).sum(), rel=1e-9)


def test_published_example(spark):
    """Weights of eleven men, the example of Shapiro and Wilk (1965)."""
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = N.rank_statistics(spark.createDataFrame([(float(v),) for v in x], "x double"), {"x": F.col("x")})["x"]
    assert got["w"] == pytest.approx(0.78881, abs=1e-5)
    assert N.shapiro_pvalue(got["w"], 11) == pytest.approx(0.0067038, abs=1e-6)


def test_counts_of_normal_columns(spark):
    rng = np.random.default_rng(2)
    x = [(float(a), float(b), float(c), 1.5, None) for a, b, c in zip(rng.normal(size=800), rng.exponential(size=800), rng.random(800))]
    fr = frame(spark.createDataFrame(x, "a double, b double, c double, d double, e double"), num=list("abcde"), cat=[])
    count = lambda *a, **k: S.ft_nr_norm(fr, *a, **k).first()["value"]
    assert [count(m) for m in (*S.NORMALITY, "all")] == [1.0] * 4
    assert count("all", failure="hard") == 1.0
    with pytest.raises(ValueError):
        count("other")


def test_columns_without_a_value(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None, 2.0), (2.0, 1.0, None, 2.0)], "a double, b double, c double, d double")
    got = N.rank_statistics(df, {c: F.col(c) for c in "abcd"})
    assert got["a"]["w"] is None and got["a"]["a2"] is not None
    assert all(got[c]["w"] is None and got[c]["a2"] is None for c in "bcd")
    assert N.rank_statistics(df.limit(0), {"a": F.col("a")}) == {"a": {"n": 0, "w": None, "a2": None}}
