"""k-th neighbours by sampled bounds and counting passes; the graph by blocks
of a class, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.operators import kth as K
from metaprism.operators import neighbourhood as NB


def _kth(spark, x, k, block_rows, top):
    mat = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "row_id long, x array<double>")
    got = K.kth_neighbours(mat, k, "manhattan", len(x), top, block_rows).collect()
    D = np.abs(np.subtract.outer(x, x))
    want = {}
    for i in range(len(x)):
        j = sorted((j for j in range(len(x)) if j != i), key=lambda j: (D[i, j], j))[k - 1]
        want[i] = (D[i, j], j)
    assert {r["row_id"]: (r["rkd"], r["rkid"]) for r in got} == want


def test_kth_outside_of_the_sampled_bounds(spark, monkeypatch):
    """The sampled block is a heap of its own, so its rows' first bounds are far too near."""
    monkeypatch.setattr(K, "SAMPLE", 1)
    blocks = 10
    of = [r[0] for r in spark.range(400).select(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(blocks))).collect()]
    x = np.array([i * 1e-6 if b == 0 else 1 + i for i, b in enumerate(of)])
    _kth(spark, x, 60, 40, 500.0)


def test_kth_among_more_ties_than_are_listed(spark):
    x = np.array([float(i % 2) for i in range(2 * K.LIST + 90)])
    _kth(spark, x, K.LIST + 200, 200, 1.0)


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((150, 2)), 2)
    x[20:30] = x[0]
    y = [None if i % 11 == 0 else "ab"[i % 7 < 5] for i in range(150)]
    df = spark.createDataFrame([(i, *map(float, v), c) for i, (v, c) in enumerate(zip(x, y))], "row_id long, e0 double, e1 double, y string")
    S = (x - x.min(0)) / np.ptp(x, axis=0)
    D = np.abs(S[:, None] - S[None]).mean(-1)
    k = round(len(x) * 0.15)
    A = np.zeros(D.shape, bool)
    for i in range(len(x)):
        for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (D[i, j], j))[:k]:
            A[i, j] = y[i] == y[j] and D[i, j] > 0
    return Frame(df=df, num=("e0", "e1"), cat=(), label="y", row_id="row_id"), A | A.T


def test_graph_features_list_no_edges(spark, graph, monkeypatch):
    fr, A = graph

    def listed(*a, **k):
        raise AssertionError("an edge list")
    monkeypatch.setattr(NB, "neighbour_edges", listed)
    A = A.astype(float)
    deg = A.sum(1)
    want = 1 - 3 * (np.trace(A @ A @ A) / 6) / (deg * (deg - 1) / 2).sum()
    assert NB.ft_cls_coef(fr, block_rows=20).first()["value"] == pytest.approx(want, abs=1e-12)
    v = np.ones(len(A))
    for _ in range(5000):
        v = A @ (A @ v)
        v /= np.linalg.norm(v)
    got = {int(r["attr"]): r["value"] for r in NB.ft_hubs(fr, block_rows=20).collect()}
    assert max(abs(got[i] - (1 - v[i] / v.max())) for i in range(len(A))) < 1e-6


def test_edges_of_rows_without_a_label(spark, graph):
    fr, A = graph
    got = {(r["a"], r["b"]) for r in NB.knn_graph_edges(fr, block_rows=20).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(A)) if i < j}


def test_pair_statistics_on_demand(spark, graph):
    """Only what is wanted is computed, with the values of the whole."""
    from metaprism.operators.pairs import pair_stats, scaled_matrix, sorted_classes
    fr, _ = graph
    mat, classes = scaled_matrix(fr, "minmax"), sorted_classes(fr)
    want = {r["row_id"]: r for r in pair_stats(mat, classes, "gower", 40).collect()}
    got = pair_stats(mat, classes, "gower", 40, want=NB.NEIGHBOURS)
    assert set(got.columns) == {"row_id", "y", "own_d", "nn_d", "nn_id", "nn_y", "ne_d", "ne_id"}
    for r in got.collect():
        assert all(r[c] == want[r["row_id"]][c] for c in got.columns)
        own = classes.index(r["y"]) if r["y"] else None
        assert r["own_d"] == (None if own is None else want[r["row_id"]][f"mn{own}"])
