"""DBSCAN on the pair kernel vs a brute-force implementation (numpy)."""

import numpy as np

from metaprism.operators import models as E
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def _brute(X, ids, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    near = D <= eps
    core = near.sum(1) >= min_samples
    lab = np.full(n, -1)
    comp = 0
    order = np.argsort(ids)
    for s in order:  # components of core rows, numbered by smallest key
        if not core[s] or lab[s] >= 0:
            continue
        stack = [s]
        lab[s] = comp
        while stack:
            v = stack.pop()
            for u in np.flatnonzero(near[v] & core):
                if lab[u] < 0:
                    lab[u] = comp
                    stack.append(u)
        comp += 1
    # border rows: cluster of the core neighbour with the smallest key-ranked cluster id
    out = lab.copy()
    for i in range(n):
        if not core[i]:
            c = [lab[u] for u in np.flatnonzero(near[i] & core) if u != i]
            out[i] = min(c) if c else -1
    return out


def test_dbscan_matches_bruteforce(spark):
    fr = embeddings_frame(spark, SF0001)
    pdf = fr.df.orderBy("row_id").toPandas()
    X = pdf[list(fr.num)].to_numpy()
    eps = float(np.quantile(np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), 0.02))
    want = _brute(X, pdf["row_id"].to_numpy(), eps, 5)
    got = E.dbscan(fr, eps=eps, min_samples=5, block_rows=128).toPandas().set_index("row_id")["pred"].astype(int)
    got = got.loc[pdf["row_id"]].to_numpy()
    # same partition (labels may be numbered differently only if ordering differs)
    assert (got == -1).tolist() == (want == -1).tolist()
    pairs_got = {(a, b) for a, b in zip(got, want)}
    assert len({a for a, _ in pairs_got}) == len(pairs_got) == len({b for _, b in pairs_got})
