"""Distributed ranks, draws and keys on large, wide, skewed and negative-keyed
frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.functions.ranking import rank_within, sorted_levels
from metaprism.operators import neighbourhood as NB
from metaprism.operators import phases as P
from metaprism.operators import splits as R
from metaprism.operators.pairs import _dist, pair_stats, scaled_matrix


def test_ranks_are_a_numbering_on_wide_skewed_frames(spark):
    n = 1_000_000
    df = (spark.range(n).select((F.col("id") - n // 2).alias("k"), F.xxhash64("id").alias("h"),
                                F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("y"),
                                *[F.concat(F.lit("wide column "), F.col("id")).alias(f"extra{i}") for i in range(4)])
          .withColumn("y", F.when(F.col("k") % 1000 == 0, None).otherwise(F.col("y"))))
    r = rank_within(df, ["y"], ["h", "k"], "rk", partitions=13)
    per = r.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("rk").alias("d"), F.min("rk").alias("a"), F.max("rk").alias("b"))
    bad = per.filter("n <> d or a <> 0 or b <> n - 1").count()
    assert bad == 0 and r.count() == n and r.columns == df.columns + ["rk"]


def test_levels(spark):
    v = spark.range(20_000).select((F.col("id") % 7001 * 3).alias("value"))
    got = sorted((r["value"], r["code"]) for r in sorted_levels(v, partitions=11).collect())
    assert got == [(3 * i, i) for i in range(7001)]


@pytest.mark.parametrize("k", [2, 3, 23, 69, 4096])
def test_draws_reach_every_value_evenly(spark, k):
    rows = spark.range(60_000).groupBy((R.hkey(F.col("id"), 42) % k).alias("v")).count().collect()
    counts = np.array([r["count"] for r in rows])
    assert len(counts) == k
    assert ((counts - 60_000 / k) ** 2 / (60_000 / k)).sum() < k + 6 * np.sqrt(2 * k)  # chi-square


def test_seeds_are_independent(spark):
    r = spark.range(30_000).select(R.hkey(F.col("id"), 1).alias("a"), R.hkey(F.col("id"), 2).alias("b")).toPandas()
    assert abs(np.corrcoef(r["a"].rank(), r["b"].rank())[0, 1]) < 0.03


def test_random_fill_uses_every_value(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 3)).alias("c"))
    fr = Frame(df=df, num=(), cat=("c",), label=None, row_id="id")
    got = P.fit_impute_str(fr, "aleatorio").transform(fr).df.where("id % 7 = 0").groupBy("c").count().collect()
    assert {r["c"] for r in got} == {"v0", "v1", "v2"}
    assert min(r["count"] for r in got) > 2500


def _frame(spark, shift, n=120, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i) + shift, *map(float, rng.normal(size=3)), "ab"[int(rng.random() < 0.5)]) for i in range(n)]
    return Frame(df=spark.createDataFrame(rows, "row_id long, a double, b double, c double, y string"),
                 num=("a", "b", "c"), cat=(), label="y", row_id="row_id")


def test_negative_keys_change_nothing(spark):
    plus, minus = _frame(spark, 0), _frame(spark, -60)
    value = lambda df: [r["value"] for r in df.collect()]
    assert value(NB.ft_n1(plus, block_rows=50)) == value(NB.ft_n1(minus, block_rows=50))
    assert len(value(NB.ft_n4(minus, block_rows=50))) == 120


def test_keyless_duplicates_stay_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a")] * 30 + [(3.0, 4.0, "b")] * 10, "u double, v double, y string")
    fr = Frame(df=df, num=("u", "v"), cat=(), label="y", row_id=None)
    st = pair_stats(scaled_matrix(fr, None), ["a", "b"], block_rows=16)
    assert st.count() == 40 and {r["n0"] + r["n1"] for r in st.collect()} == {39}


def test_distance_does_not_cancel():
    rng = np.random.default_rng(0)
    x = 1e5 + rng.normal(scale=1e-3, size=(1500, 4))
    d = _dist(x, x, "euclidean")
    want = np.sqrt(((x[:40, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert np.allclose(d[:40], want, rtol=1e-12, atol=0)


def test_interpolated_rows_lie_between_rows_of_the_class(spark):
    fr = _frame(spark, -60)
    out = R.interpolate_rows(fr, seed=3).toPandas()
    base = fr.df.toPandas()
    assert sorted(out["y"]) == sorted(base["y"]) and set(out["row_id"]) == set(base["row_id"])
    for y, g in out.groupby("y"):
        b = base[base["y"] == y]
        assert (g[["a", "b", "c"]].min() >= b[["a", "b", "c"]].min()).all() and (g[["a", "b", "c"]].max() <= b[["a", "b", "c"]].max()).all()
