"""Regression trees over cells of equal features: as over rows."""

import math

import numpy as np
import pytest
from pyspark.ml import regression as MR
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.operators import models as E


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 2400
    a, b = rng.integers(0, 9, n), rng.integers(0, 5, n)
    y = 3.0 * a - 2.0 * b * b + rng.normal(0, 2, n)
    rows = [(i, float(a[i]), float(b[i]), float(y[i])) for i in range(n)]
    return Frame(df=spark.createDataFrame(rows, "row_id long, a double, b double, t double").cache(), num=("a", "b"), row_id="row_id")


def _pred(df):
    return np.array([r["pred"] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("name", ["arbol_decision", "gradient_boosting"])
def test_trees_over_cells_are_those_over_rows(data, name, monkeypatch):
    if name == "gradient_boosting":
        monkeypatch.setitem(E.REGRESSORS, name, lambda n, spread, seed: MR.GBTRegressor(maxIter=5, maxDepth=3, seed=seed))
    got = E.fit_regressor(name, data, "t")
    assert data.memo(("cells", "t"), None)[1] == 45
    want = E.REGRESSORS[name](2400, 1.0, 42).setFeaturesCol(E.FEAT).setLabelCol("t").setPredictionCol("pred").fit(
        E.assemble(data.df, data.num))
    assert _pred(got.predict(data.df)) == pytest.approx(_pred(want.transform(E.assemble(data.df, data.num))), rel=1e-9)


def test_bags_hold_every_row_as_often_as_drawn(data):
    bags = E.bootstrap_cells(data, "t", 12, seed=5)
    assert len(bags) == 12
    draws = data.df.select("a", "b", "t", *[E.poisson_draw("row_id", 5, i).alias(f"w{i}") for i in range(12)]).toPandas()
    for i in (0, 11):
        got = {(r["a"], r["b"]): (r[E.CNT], r["t"]) for r in bags[i].collect()}
        w = draws[f"w{i}"]
        want = (draws["t"] * w).groupby([draws["a"], draws["b"]]).sum(), w.groupby([draws["a"], draws["b"]]).sum()
        assert {k: v[0] for k, v in got.items()} == {k: v for k, v in want[1].items() if v > 0}
        for k, (c, t) in got.items():
            assert t == pytest.approx(want[0][k] / c)
    all_draws = draws[[f"w{i}" for i in range(12)]].to_numpy()
    for j in range(4):
        assert (all_draws == j).mean() == pytest.approx(math.exp(-1) / math.factorial(j), abs=0.01)
    assert abs(np.corrcoef(all_draws.T) - np.eye(12)).max() < 0.1


def test_a_forest_over_cells_fits_no_rows(data, monkeypatch):
    monkeypatch.setitem(E.REGRESSORS, "random_forest", lambda n, spread, seed: MR.RandomForestRegressor(numTrees=12, maxDepth=10, seed=seed))
    sizes, fit = [], MR.RandomForestRegressor._fit
    monkeypatch.setattr(MR.RandomForestRegressor, "_fit", lambda est, df: sizes.append(df.count()) or fit(est, df))
    got = _pred(E.fit_regressor("random_forest", data, "t").predict(data.df))
    assert len(sizes) == 12 and max(sizes) <= 45
    sizes.clear()
    monkeypatch.setattr(E, "CELL_ROWS", 1000)
    rows = _pred(E.fit_regressor("random_forest", data, "t").predict(data.df))
    assert sizes == [2400]
    y = np.array([r["t"] for r in data.df.orderBy("row_id").collect()])
    assert np.mean((got - rows) ** 2) < 0.1 * np.var(y)
    assert 1 - np.mean((y - got) ** 2) / np.var(y) == pytest.approx(1 - np.mean((y - rows) ** 2) / np.var(y), abs=0.03)


def test_a_null_target_is_refused(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 3 else 1.0) for i in range(40)], "row_id long, a double, t double")
    with pytest.raises(Exception):
        E.fit_regressor("arbol_decision", Frame(df=df, num=("a",), row_id="row_id"), "t")


def test_a_cell_that_no_draw_has_is_left_out(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), F.lit(2.0).alias("t"))
    got = E.bootstrap_cells(Frame(df=df, num=("a",), row_id="row_id"), "t", 2, seed=1)[0].collect()
    assert 0 < len(got) < 40 and {r["t"] for r in got} == {2.0}
