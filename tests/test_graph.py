"""Boruvka spanning forest on the pair kernel vs Prim's algorithm (numpy)."""

import numpy as np

from metaprism.frame import Frame
from metaprism.operators import neighbourhood as NB
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def _prim_weight_and_n1(X, y):
    n = len(X)
    D = np.abs(X[:, None, :] - X[None, :, :]).mean(-1)
    D[D == 0] = np.inf
    np.fill_diagonal(D, np.inf)
    in_tree = np.zeros(n, bool)
    best = np.full(n, np.inf)
    parent = np.full(n, -1)
    total, edges = 0.0, []
    for start in range(n):
        if in_tree[start]:
            continue
        best[start] = 0
        while True:
            cand = np.where(~in_tree, best, np.inf)
            v = int(np.argmin(cand))
            if not np.isfinite(cand[v]):
                break
            in_tree[v] = True
            if parent[v] >= 0:
                total += D[v, parent[v]]
                edges.append((v, parent[v]))
            upd = (~in_tree) & (D[v] < best)
            best[upd] = D[v][upd]
            parent[upd] = v
    verts = {a for e in edges for a in e if y[e[0]] != y[e[1]]}
    return total, len(verts) / n


def test_spanning_forest_matches_prim(spark):
    fr = embeddings_frame(spark, SF0001)
    pdf = fr.df.orderBy("row_id").toPandas()
    X = pdf[list(fr.num)].to_numpy()
    X = (X - X.min(0)) / np.where(np.ptp(X, 0) == 0, 1, np.ptp(X, 0))
    w_ref, n1_ref = _prim_weight_and_n1(X, pdf["y"].to_numpy())
    edges = NB.minimum_spanning_forest(fr, "gower", "minmax", block_rows=128)
    w = edges.agg({"d": "sum"}).first()[0]
    assert abs(w - w_ref) < 1e-9 * max(1.0, w_ref)
    n1 = NB.ft_n1(fr, block_rows=128).first()["value"]
    assert abs(n1 - n1_ref) < 1e-12


def test_forest_searches_few_rows_again(spark):
    """Copies, two far clusters and a row apart: the edges are Prim's, and rows
    that know their neighbours do not search in every round."""
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(40, 1, (100, 2)), [[90.0, 5.0]]])
    X = np.concatenate([X, X[:30], X[:30], X[200:220]])
    y = rng.choice(["a", "b"], len(X))
    df = spark.createDataFrame([(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(X, y.tolist()))], "row_id long, p double, q double, y string")
    fr = Frame(df=df, num=("p", "q"), label="y", row_id="row_id")
    X = (X - X.min(0)) / np.ptp(X, 0)
    w_ref, n1_ref = _prim_weight_and_n1(X, y)
    log = []
    edges = NB.minimum_spanning_forest(fr, "gower", "minmax", block_rows=64, log=log).toPandas()
    assert len(edges) == len(X) - 1 and abs(edges["d"].sum() - w_ref) < 1e-9
    on_border = {v for a, b in zip(edges["src"], edges["dst"]) for v in (a, b) if y[a] != y[b]}
    assert abs(len(on_border) / len(X) - n1_ref) < 1e-12
    assert log[0] == 251 and sum(log) < 3 * log[0]


def test_forest_of_few_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, 0.0, "b"), (3, 0.0, "a")], "row_id long, p double, y string")
    fr = Frame(df=rows, num=("p",), label="y", row_id="row_id")
    assert NB.minimum_spanning_forest(fr).count() == 0  # zero distances are no edge
