"""cls_coef (transitivity of the k-NN graph) vs a dense numpy graph."""

import os

import numpy as np
import pytest

from metaprism.operators import neighbourhood as NB
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def test_cls_coef_matches_dense_graph(spark):
    fr = embeddings_frame(spark, SF0001)
    pdf = fr.df.orderBy("row_id").toPandas()
    X = pdf[list(fr.num)].to_numpy()
    X = (X - X.min(0)) / np.where(np.ptp(X, 0) == 0, 1, np.ptp(X, 0))
    y, ids = pdf["y"].to_numpy(), pdf["row_id"].to_numpy()
    n = len(X)
    D = np.abs(X[:, None, :] - X[None, :, :]).mean(-1)
    k = int(round(n * 0.15))
    A = np.zeros((n, n), bool)
    for i in range(n):
        cand = sorted((j for j in range(n) if j != i), key=lambda j: (D[i, j], ids[j]))
        for j in cand[:k]:
            if y[i] == y[j] and D[i, j] > 0:
                A[i, j] = True
    A = (A | A.T).astype(float)
    tri = np.trace(A @ A @ A) / 6
    deg = A.sum(1)
    triples = (deg * (deg - 1) / 2).sum()
    want = 1 - 3 * tri / triples
    got = NB.ft_cls_coef(fr, block_rows=128).first()["value"]
    assert abs(got - want) < 1e-12


def test_hubs_match_principal_eigenvector(spark):
    fr = embeddings_frame(spark, SF0001)
    pdf = fr.df.orderBy("row_id").toPandas()
    X = pdf[list(fr.num)].to_numpy()
    X = (X - X.min(0)) / np.where(np.ptp(X, 0) == 0, 1, np.ptp(X, 0))
    y, ids = pdf["y"].to_numpy(), pdf["row_id"].to_numpy()
    n = len(X)
    D = np.abs(X[:, None, :] - X[None, :, :]).mean(-1)
    k = int(round(n * 0.15))
    A = np.zeros((n, n), bool)
    for i in range(n):
        cand = sorted((j for j in range(n) if j != i), key=lambda j: (D[i, j], ids[j]))
        for j in cand[:k]:
            if y[i] == y[j] and D[i, j] > 0:
                A[i, j] = True
    A = (A | A.T).astype(float)
    w, vecs = np.linalg.eigh(A @ A)
    v = np.abs(vecs[:, -1])
    v = v / v.max()
    got = {int(r["attr"]): r["value"] for r in NB.ft_hubs(fr, block_rows=128).collect()}
    want = {int(i): 1 - s for i, s in zip(ids, v)}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6
