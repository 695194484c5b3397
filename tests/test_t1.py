"""t1 by activity rounds on the pair kernel vs the sequential absorption loop."""

import numpy as np

from metaprism.operators import neighbourhood as NB
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def _sequential_t1(X, y, ids):
    n = len(X)
    D = np.abs(X[:, None, :] - X[None, :, :]).mean(-1)
    enemy = y[:, None] != y[None, :]
    De = np.where(enemy, D, np.inf)
    ne = np.lexsort((np.broadcast_to(ids, D.shape), De), axis=1)[:, 0]
    ned = De[np.arange(n), ne]
    r = np.full(n, -1.0)
    for i in range(n):
        if ne[ne[i]] == i:
            r[i] = 0.5 * ned[i]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            if r[i] < 0 and r[ne[i]] >= 0:
                r[i] = abs(ned[i] - r[ne[i]])
                changed = True
    r[r < 0] = ned[r < 0]
    inside = D <= r[None, :]            # inside[j, i]: j in sphere i
    mass = inside.sum(0)
    order = sorted(range(n), key=lambda i: (-mass[i], ids[i]))
    count = np.ones(n, dtype=int)
    for i in order:
        if count[i] <= 0:
            continue
        members = np.flatnonzero(inside[:, i])
        tot = int(count[members].sum())
        count[members] = 0
        count[i] = tot
    return float((count > 0).sum()) / n


def test_t1_matches_sequential_loop(spark):
    fr = embeddings_frame(spark, SF0001)
    pdf = fr.df.orderBy("row_id").toPandas()
    X = pdf[list(fr.num)].to_numpy()
    X = (X - X.min(0)) / np.where(np.ptp(X, 0) == 0, 1, np.ptp(X, 0))
    want = _sequential_t1(X, pdf["y"].to_numpy(), pdf["row_id"].to_numpy())
    got = NB.ft_t1(fr, block_rows=128).first()["value"]
    assert abs(got - want) < 1e-12
