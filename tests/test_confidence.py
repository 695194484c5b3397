"""Bootstrap intervals against plain numpy over repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import frame
from metaprism.operators import resampling as B
from metaprism.operators import statistical as S
from metaprism.operators.splits import bootstrap_ci, hkey
from metaprism.plans.extract import extract, extract_with_confidence

R = 128


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    y = rng.choice(list("abc"), 240, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(240, 3)) * [1, 5, 0.1] + np.array([["abc".index(v) * 0.5, 20, 1] for v in y])
    rows = [(i, *map(float, v), str(c)) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, p double, q double, r double, y string").repartition(4)
    return frame(df, label="y", num=["p", "q", "r"], cat=[], row_id="id")


@pytest.fixture(scope="module")
def repeated(data):
    """Per replicate the rows, each as often as it is drawn."""
    rows = sorted((r["id"], r["d"], [r["p"], r["q"], r["r"]], r["y"]) for r in data.df.withColumn("d", hkey(F.col("id"), 1234)).collect())
    w = B.replicate_weights(np.array([r[1] for r in rows]), R).astype(int)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    return [(np.repeat(x, w[:, k], axis=0), np.repeat(y, w[:, k])) for k in range(R + 1)]


def test_weights_are_poisson(repeated):
    n = np.array([len(y) for _, y in repeated[1:]])
    assert abs(n.mean() - 240) < 6 and 10 < n.std() < 22
    w = B.replicate_weights(np.arange(100_000), 3)[:, 1:]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w.T)[0, 1]) < 0.01


def _plain(feature, x, y):
    n, lower = len(x), np.tril_indices(3, -1)
    c = x - x.mean(0)
    classes, counts = np.unique(y, return_counts=True)
    return {
        "mean": x.mean(0), "sd": x.std(0, ddof=1), "var": x.var(0, ddof=1), "min": x.min(0), "max": x.max(0), "range": np.ptp(x, axis=0),
        "skewness": (c ** 3).mean(0) / (c ** 2).mean(0) ** 1.5 * ((n - 1) / n) ** 1.5,
        "kurtosis": (c ** 4).mean(0) / (c ** 2).mean(0) ** 2 * (1 - 1 / n) ** 2 - 3,
        "g_mean": np.array([np.nan if v.min() < 0 else np.exp(np.log(v).mean()) for v in x.T]),
        "h_mean": np.array([np.nan if v.min() < 0 else n / (1 / v).sum() for v in x.T]),
        "cov": np.abs(np.cov(x.T)[lower]), "cor": np.abs(np.corrcoef(x.T)[lower]),
        "nr_cor_attr": np.array([(np.abs(np.corrcoef(x.T)[lower]) >= 0.5).mean()]),
        "eigenvalues": np.linalg.eigvalsh(np.cov(x.T)), "freq_class": counts / n,
        "nr_class": np.array([len(classes)]), "nr_inst": np.array([n]),
        "gravity": np.array([np.linalg.norm(x[y == classes[counts.argmax()]].mean(0) - x[y == classes[counts.argmin()]].mean(0))]),
    }[feature]


def test_every_replicate_as_over_repeated_rows(data, repeated):
    re = B.resampled(data, R, with_pairs=True)
    for f in B.FEATURES:
        if f in ("sd_ratio", "can_cor", "nr_disc", "w_lambda", "p_trace", "lh_trace", "roy_root"):
            continue
        for got, (x, y) in zip(B.replicate_values(re, f), repeated):
            np.testing.assert_allclose(got, _plain(f, x, y), rtol=1e-7, atol=1e-10, err_msg=f)


def test_discriminant_features_of_replicates(spark, data, repeated):
    """The data and two replicates as frames of their own."""
    re = B.resampled(data, 2, with_pairs=True)
    for k in range(3):
        x, y = repeated[k]
        df = spark.createDataFrame([(*map(float, v), str(c)) for v, c in zip(x, y)], "p double, q double, r double, y string")
        fr = frame(df, label="y", num=["p", "q", "r"], cat=[])
        for f in ("sd_ratio", "can_cor", "nr_disc", "w_lambda", "p_trace", "lh_trace", "roy_root"):
            want = [r["value"] for r in S.FEATURES[f](fr).orderBy("idx").collect()]
            np.testing.assert_allclose(B.replicate_values(re, f)[k], want, rtol=1e-7, err_msg=f)


def test_intervals(data, repeated):
    with pytest.warns(RuntimeWarning, match="median"):
        rows = extract_with_confidence(data, "statistical", replicates=R, confidence=(0.8, 0.95)).collect()
    got = {(r["name"], r["confidence"]): (r["value"], r["lower"], r["upper"]) for r in rows}
    for name, pick in (("var.mean", lambda x, y: x.var(0, ddof=1).mean()), ("cor.sd", lambda x, y: _plain("cor", x, y).std(ddof=1)),
                       ("gravity", lambda x, y: _plain("gravity", x, y)[0]), ("max.sd", lambda x, y: x.max(0).std(ddof=1))):
        v = np.array([pick(x, y) for x, y in repeated])
        for c in (0.8, 0.95):
            lo, hi = np.quantile(v[1:] - v[0], [(1 - c) / 2, (1 + c) / 2])
            np.testing.assert_allclose(got[name, c], (v[0], v[0] - hi, v[0] - lo), rtol=1e-7)
    plain = {r["name"]: r["value"] for r in extract(data, "statistical", ["mean", "cov", "eigenvalues", "w_lambda", "sd_ratio"]).collect()}
    for name, v in plain.items():
        assert got[name, 0.95][0] == pytest.approx(v, rel=1e-7), name


def test_slow_features_by_replicate_frames(spark, data, repeated):
    got = extract_with_confidence(data, "statistical", ["median"], replicates=3, slow_features=True).collect()
    v = np.array([np.median(x, axis=0).mean() for x, _ in repeated[:4]])
    lo, hi = np.quantile(v[1:] - v[0], [0.025, 0.975])
    row = next(r for r in got if r["name"] == "median.mean")
    np.testing.assert_allclose((row["value"], row["lower"], row["upper"]), (v[0], v[0] - hi, v[0] - lo), rtol=1e-9)


def test_gaps_hot_class_and_empty(spark):
    rows = [(float(i % 7) if i % 3 else None, float("nan") if i % 5 == 0 else float(i), 2.5, "hot" if i % 10 else None) for i in range(300)]
    fr = frame(spark.createDataFrame(rows, "a double, b double, c double, y string"), label="y", num=list("abc"), cat=[])
    re = B.resampled(fr, 4, with_pairs=True)
    a = [r[0] for r in rows if r[0] is not None]
    assert set(re.rows) == {None, "hot"}
    assert B.replicate_values(re, "mean")[0] == pytest.approx([np.mean(a), np.mean([r[1] for r in rows if r[1] == r[1]]), 2.5])
    assert B.replicate_values(re, "sd")[3][2] == 0.0 and np.isnan(B.replicate_values(re, "skewness")[1][2])
    empty = fr.with_df(fr.df.limit(0))
    assert extract_with_confidence(empty, "statistical", ["mean"]).count() == 0


def test_column_intervals(data, repeated):
    got = {r["attr"]: r for r in bootstrap_ci(data, "sd", R).collect()}
    v = np.array([x.std(0, ddof=1) for x, _ in repeated])
    lo, hi = np.quantile(v[1:] - v[0], [0.025, 0.975], axis=0)
    for i, c in enumerate("pqr"):
        np.testing.assert_allclose((got[c]["theta"], got[c]["lower"], got[c]["upper"]), (v[0][i], v[0][i] - hi[i], v[0][i] - lo[i]), rtol=1e-7)
