"""density (k-NN graph, no edge list) vs a dense brute-force graph."""

import numpy as np

from metaprism.operators import neighbourhood as NB
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def test_density_matches_bruteforce(spark):
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
        cand = [j for j in range(n) if j != i]
        cand.sort(key=lambda j: (D[i, j], ids[j]))
        for j in cand[:k]:
            if y[i] == y[j] and D[i, j] > 0:
                A[i, j] = True
    A = A | A.T
    want = 1.0 - A.sum() / 2 / (n * (n - 1) / 2)
    got = NB.ft_density(fr, block_rows=128).first()["value"]
    assert abs(got - want) < 1e-12
