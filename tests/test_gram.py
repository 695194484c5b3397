"""The blocked Gram kernel against the expression-a-pair aggregates and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import frame
from metaprism.operators import moments as M
from metaprism.operators import statistical as S


@pytest.fixture(scope="module")
def gappy(spark):
    """Nulls, a constant column, a column without values, far-off means, a class
    of one row and a null class."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 7)) * 10 + np.arange(7) * 1e5
    x[:, 2] = 0.1
    x[:, 5] = x[:, 0] * 2 + rng.normal(size=400)
    rows = []
    for i, r in enumerate(x):
        y = "one" if i == 0 else None if i % 11 == 0 else "abc"[i % 3]
        rows.append((*[None if rng.random() < 0.1 and c in (1, 4) else float(v) for c, v in enumerate(r)], None, y))
    cols = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y string").repartition(5)
    return frame(df, label="y", num=cols, cat=[])


def _values(df):
    return {(r["attr"], r["idx"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("feature", [S.ft_cov, S.ft_cor])
@pytest.mark.parametrize("size", [3, 128])
def test_pairs_as_by_expressions(gappy, feature, size):
    got, want = _values(feature(gappy, blocked=True, size=size)), _values(feature(gappy, blocked=False))
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v is None or np.isnan(v):
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-9), k


def test_class_covariances_as_by_expressions(gappy, monkeypatch):
    want, cov = M._class_scatter(gappy, list(gappy.num)), M._covariance(gappy, list(gappy.num))
    monkeypatch.setattr(M, "MAX_PAIRWISE_COLS", 3)
    got, cov2 = M._class_scatter(gappy, list(gappy.num)), M._covariance(gappy, list(gappy.num))
    assert got.classes == want.classes
    np.testing.assert_allclose(got.covs, want.covs, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got.means, want.means, rtol=1e-12)
    np.testing.assert_allclose(cov2[0], cov[0], rtol=1e-7, atol=1e-9)
    assert cov2[1] == cov[1]


def test_nr_cor_attr_beyond_the_expressions(gappy, monkeypatch):
    fr = gappy.with_df(gappy.df, num=("x0", "x1", "x3", "x4", "x5", "x6"))
    want = S.ft_nr_cor_attr(fr).first()["value"]
    monkeypatch.setattr(M, "MAX_PAIRWISE_COLS", 3)
    assert S.ft_nr_cor_attr(fr).first()["value"] == pytest.approx(want) and want > 0


def test_empty_table(gappy):
    fr = gappy.with_df(gappy.df.limit(0))
    assert S.ft_cov(fr, blocked=True).count() == 0


def test_a_thousand_columns(spark):
    """Against numpy; eigenvalues, discriminant and pair features all have values."""
    rng = np.random.default_rng(9)
    d, n = 1000, 1500
    mix = rng.normal(size=(12, d))
    x = np.round(rng.normal(size=(n, 12)) @ mix + rng.normal(size=(n, d)), 3)
    y = np.where(x[:, 0] + x[:, 1] > 0, "p", "q")
    rows = [(v.tolist(), str(c)) for v, c in zip(x, y)]
    df = spark.createDataFrame(rows, "v array<double>, y string").repartition(4)
    cols = [f"x{i}" for i in range(d)]
    fr = frame(df.select("y", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)]), label="y", num=cols, cat=[])
    cov = np.cov(x.T)
    got = S.ft_cov(fr).where("idx % 997 = 0").collect()
    lower = np.tril_indices(d, -1)
    assert len(got) == -(-len(lower[0]) // 997)
    for r in got:
        i, j = lower[0][r["idx"]], lower[1][r["idx"]]
        assert r["attr"] == f"x{i}|x{j}" and r["value"] == pytest.approx(abs(cov[i, j]), rel=1e-7, abs=1e-10)
    np.testing.assert_allclose(M.covariance(fr)[0], cov, rtol=1e-7, atol=1e-9)
    sc = M.class_scatter(fr)
    for c, m in zip(sc.classes, sc.covs):
        np.testing.assert_allclose(m, np.cov(x[y == c].T), rtol=1e-7, atol=1e-9)
    hits = (np.abs(np.corrcoef(x.T)[lower]) >= 0.5).mean()
    assert S.ft_nr_cor_attr(fr).first()["value"] == pytest.approx(hits)
