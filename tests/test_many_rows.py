"""Neighbour features of many rows, by cells, against the pair kernel."""

import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.operators import landmarking as L
from metaprism.operators import models as E
from metaprism.operators import neighbourhood as NB
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


@pytest.fixture(scope="module")
def odd(spark):
    """Embeddings with equal rows of one and of two classes, a class of one row and null labels."""
    fr = embeddings_frame(spark, SF0001)
    i = F.col("row_id")
    df = fr.df.withColumns({c: F.when(i < 60, F.round(F.lit(0.1), 1)).otherwise(F.col(c)) for c in fr.num})
    y = F.when(i < 30, "a").when(i == 200, "alone").when(i.between(300, 310), None).when(i % 3 == 0, F.col("y")).otherwise("b")
    return fr.with_df(df.withColumn("y", y).cache())


def _values(df):
    return {(r["feature"], r["attr"], r["idx"]): r["value"] for r in df.collect()}


def test_neighbourhood(spark, odd, monkeypatch):
    def run():
        ctx = NB.PairContext(odd, "gower", "minmax", 64, want=NB.NEIGHBOURS)
        rows = {r["row_id"]: tuple(r)[2:] for r in ctx.stats.select("row_id", "y", "own_d", "nn_d", "nn_id", "nn_y", "ne_d", "ne_id").collect()}
        return rows, {n: _values(f(ctx)) for n, f in (("n3", NB.ft_n3), ("lsc", NB.ft_lsc))}  # n2 divides by ne_d, which is 0 here
    rows, want = run()
    monkeypatch.setattr(NB, "PAIR_ROWS", 0)
    asked = []
    monkeypatch.setattr(NB, "pair_stats", lambda *a, **k: asked.append(a))
    got, values = run()
    assert not asked and got.keys() == rows.keys()
    for i, r in rows.items():
        assert got[i] == r, i
    for n, w in want.items():
        assert values[n] == pytest.approx(w, nan_ok=True, abs=1e-15), n


def test_t1(spark, odd, monkeypatch):
    fr = odd.with_df(odd.df.where("y IS NOT NULL"))
    want = NB.ft_t1(fr, block_rows=64).first()["value"]
    monkeypatch.setattr(NB, "PAIR_ROWS", 0)
    monkeypatch.setattr(NB, "_containers", None)
    assert NB.ft_t1(fr, block_rows=64).first()["value"] == want


def test_landmarks(spark, odd, monkeypatch):
    fr = odd.with_df(odd.df.where("y IS NOT NULL"))
    want = _values(L.ft_one_nn(fr)), _values(L.ft_elite_nn(fr))
    monkeypatch.setattr(L, "PAIR_ROWS", 0)
    monkeypatch.setattr(L, "pair_stats", None)
    fr = odd.with_df(odd.df.where("y IS NOT NULL"))
    assert (_values(L.ft_one_nn(fr)), _values(L.ft_elite_nn(fr))) == want


def test_trees_of_many_rows_one_at_a_time(spark, odd, monkeypatch):
    fr = odd.with_df(odd.df.where("y IS NOT NULL"))
    now, most, fit = [0], [0], L._tree_importances

    def one(train, seed):
        now[0] += 1
        most[0] = max(most[0], now[0])
        out = fit(train, seed)
        now[0] -= 1
        return out
    monkeypatch.setattr(L, "_tree_importances", one)
    monkeypatch.setattr(L, "TREE_ROWS", 100)
    L._fold_importances(fr, L._folded(fr, 4), 4, 0)
    assert most[0] == 1
    assert all(E.MLLIB_CLASSIFIERS[n](1, 0).getCacheNodeIds() for n in ("decision_tree", "random_forest"))


def test_the_graph_is_found_once(spark, monkeypatch):
    fr = embeddings_frame(spark, SF0001)
    found, kth = [], NB.kth_neighbours
    monkeypatch.setattr(NB, "kth_neighbours", lambda *a: found.append(a) or kth(*a))
    NB.ft_density(fr)
    NB.ft_cls_coef(fr)
    assert len(found) == 1
