"""Metric partitioner against brute force: nearest rows, nearest enemies and
density clusters, with ties, copies and many dimensions; frames without keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame, keyed
from metaprism.functions.components import connected_components
from metaprism.operators import cells as C
from metaprism.operators import landmarking as L
from metaprism.operators import models as E
from metaprism.operators import neighbourhood as NB
from metaprism.operators import splits as R
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def dist(A, B, metric):
    diff = A[:, None, :] - B[None, :, :]
    return np.sqrt((diff * diff).sum(-1)) if metric == "euclidean" else np.abs(diff).mean(-1)


def matrix(spark, X, y=None):
    y = ["_"] * len(X) if y is None else y
    return spark.createDataFrame([(i, str(y[i]), [float(v) for v in X[i]]) for i in range(len(X))], "row_id long, y string, x array<double>").repartition(4)


def lattice(n, seed=3):
    """Whole numbers in few places: many equal rows and equal distances."""
    return np.random.default_rng(seed).integers(0, 6, (n, 3)).astype(float)


def brute_knn(X, k, metric):
    D = dist(X, X, metric)
    np.fill_diagonal(D, np.inf)
    return {i: [(j, D[i, j]) for j in np.lexsort((np.arange(len(X)), D[i]))[:k]] for i in range(len(X))}


def rows_of(df):
    out = {}
    for r in df.orderBy("row_id", "rank").collect():
        out.setdefault(r["row_id"], []).append((r["id"], r["d"]))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "gower"])
def test_nearest_rows_with_ties(spark, metric):
    X = lattice(400)
    got, want = rows_of(C.nearest_rows(matrix(spark, X), 4, metric, cell_rows=30)), brute_knn(X, 4, metric)
    assert {i: [j for j, _ in r] for i, r in got.items()} == {i: [j for j, _ in r] for i, r in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for i in got for a, b in zip(got[i], want[i]))


def test_nearest_rows_in_64_dimensions_visits_few_cells(spark):
    em = spark.read.parquet(f"{SF0001}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.lit("_").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    pdf = em.orderBy("row_id").toPandas()
    rng = np.random.default_rng(1)
    base = np.stack(pdf["x"].to_numpy())
    centres = base[rng.choice(len(base), 20, replace=False)] * 5
    X = np.concatenate([base, centres[rng.integers(0, 20, 1500)] + rng.normal(0, 0.05, (1500, base.shape[1]))])
    log = []
    got, want = rows_of(C.nearest_rows(matrix(spark, X), 5, "euclidean", cell_rows=25, log=log)), brute_knn(X, 5, "euclidean")
    assert {i: [j for j, _ in r] for i, r in got.items()} == {i: [j for j, _ in r] for i, r in want.items()}
    (visits, cells), = log
    assert cells > 40 and sum(visits) < 0.5 * len(X) * cells


def test_a_frequent_row_is_searched_for_once(spark):
    X = np.concatenate([np.ones((3000, 4)), np.random.default_rng(2).normal(0, 1, (600, 4))])
    log = []
    got = rows_of(C.nearest_rows(matrix(spark, X), 3, "euclidean", cell_rows=50, log=log))
    assert len(got) == len(X) and all(len(r) == 3 for r in got.values())
    assert [j for j, _ in got[0]] == [1, 2, 3] and [j for j, _ in got[2999]] == [0, 1, 2]
    assert sum(log[0][0]) < 601 * log[0][1]


def test_nearest_in_other_rows(spark):
    X, Q = lattice(200), lattice(50, 9) + 0.25
    got = rows_of(C.nearest_in(matrix(spark, X), matrix(spark, Q).select("row_id", "x"), 3, "euclidean", cell_rows=20))
    D = dist(Q, X, "euclidean")
    assert {i: [j for j, _ in r] for i, r in got.items()} == {i: np.lexsort((np.arange(200), D[i]))[:3].tolist() for i in range(50)}


@pytest.mark.parametrize("positive", [False, True])
def test_enemies_as_groups_change(spark, positive):
    X = lattice(300)
    search = C.Enemies(matrix(spark, X), "gower", cell_rows=25, positive=positive)
    for groups in (np.arange(300) % 3, np.arange(300), np.zeros(300, int), X[:, 0].astype(int)):
        g = spark.createDataFrame([(i, int(v)) for i, v in enumerate(groups)], "row_id long, g long")
        got = {r["row_id"]: (r["ne_id"], round(r["ne_d"], 12)) for r in search.nearest(g).collect()}
        D = dist(X, X, "gower")
        D = np.where((groups[:, None] != groups[None, :]) & ((D > 0) | (not positive)), D, np.inf)
        want = {i: (int(D[i].argmin()), round(D[i].min(), 12)) for i in range(300) if np.isfinite(D[i].min())}
        assert got == want


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {v: find(v) for a, b in edges for v in (a, b) if a != b}
    assert got == want


@pytest.mark.parametrize("eps", [1.0, 1.5])
def test_density_clusters_with_ties(spark, eps):
    X = np.concatenate([lattice(150) * 1.0, lattice(60, 5) + 40, np.array([[99.0, 0, 0]] * 2)])
    D = dist(X, X, "euclidean") <= eps
    core = D.sum(1) >= 6
    want = {}
    label = np.where(core, np.arange(len(X)), len(X))
    while True:
        new = np.where(core, np.where(D & core[None, :], label[None, :], len(X)).min(1), len(X))
        if (new == label).all():
            break
        label = new
    for i in range(len(X)):
        r = label[i] if core[i] else np.where(D[i] & core, label, len(X)).min()
        want[i] = None if r == len(X) else int(r)
    log = []
    got = {r["row_id"]: r["root"] for r in C.density_clusters(matrix(spark, X), eps, 6, cell_rows=12, log=log).collect()}
    assert got == want and len({v for v in want.values()}) > 2
    assert len(log[0][0]) == 2  # two passes, however long the clusters


def test_one_cell_and_empty(spark):
    X = lattice(20)
    assert rows_of(C.nearest_rows(matrix(spark, X), 50)).keys() == set(range(20))
    empty = matrix(spark, X).limit(0)
    assert C.nearest_rows(empty, 3).count() == 0 and C.density_clusters(empty, 1.0, 3).count() == 0


def test_frames_without_a_key(spark):
    em = embeddings_frame(spark, SF0001)
    df = em.df.orderBy("row_id").limit(150).drop("row_id").checkpoint(eager=True)
    bare = Frame(df=df, num=em.num, label="y")
    with_key = Frame(df=df.withColumn("k", F.monotonically_increasing_id()), num=em.num, label="y", row_id="k")
    assert keyed(bare) is keyed(bare) and keyed(with_key) is with_key
    for split in (lambda f: R.kfold_stratified(f, 3), lambda f: R.kfold_stratified(f, 3, shuffle=False), lambda f: R.kfold_plain(f, 3), lambda f: R.sample_rows(f, 0.5)):
        a, b = split(bare), split(with_key)
        assert "_row" not in a.columns and sorted(map(tuple, a.collect())) == sorted(tuple(r) for r in b.drop("k").collect())
    value = lambda out: sorted((r["idx"], r["value"]) for r in out.collect())
    for feature in (NB.ft_n1, L.ft_one_nn, L.ft_naive_bayes, lambda f: NB.ft_hubs(f, radius_frac=0.1)):
        got, want = value(feature(bare)), value(feature(with_key))
        assert np.isfinite(got).all() and np.allclose(got, want)
    assert R.interpolate_rows(bare).count() == 150
    text = Frame(df=df.withColumn("k", F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string"))), num=em.num, label="y", row_id="k")
    assert value(NB.ft_n1(text)) == value(NB.ft_n1(bare))
    assert E.dbscan(bare, eps=0.5).count() == 150


@pytest.mark.parametrize("k", [1, 40, 119, 200])
def test_kth_neighbour_by_counting(spark, k):
    """Against sorting, on rows of which hundreds are equally far."""
    from metaprism.operators.kth import kth_neighbours, neighbour_edges
    X = np.concatenate([lattice(160), np.zeros((150, 3))]) / 5
    y = (np.arange(len(X)) % 2).astype(str)
    mat = matrix(spark, X, y)
    kth = kth_neighbours(mat, k, "gower", len(X), 1.0, block_rows=100)
    D = dist(X, X, "gower")
    np.fill_diagonal(D, np.inf)
    order = {i: np.lexsort((np.arange(len(X)), D[i])) for i in range(len(X))}
    got = {r["row_id"]: (r["rkid"], r["rkd"]) for r in kth.collect()}
    assert {i: v[0] for i, v in got.items()} == {i: int(o[k - 1]) for i, o in order.items()}
    edges = sorted(map(tuple, neighbour_edges(mat, kth, "gower", len(X), block_rows=100).collect()))
    assert edges == sorted({(min(i, j), max(i, j)) for i, o in order.items() for j in o[:k].tolist() if y[i] == y[j] and D[i, j] > 0})
