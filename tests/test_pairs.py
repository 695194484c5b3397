"""Pair kernel: tiling must not change any statistic (exactness)."""

import numpy as np
from pyspark.sql import functions as F

from metaprism.operators import neighbourhood as NB
from metaprism.operators.pairs import pair_stats, scaled_matrix, sorted_classes
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def _collect(df, cols):
    return {r["row_id"]: tuple(r[c] for c in cols) for r in df.select("row_id", *cols).collect()}


def test_tiles_equal_single_block(spark):
    fr = embeddings_frame(spark, SF0001)
    classes = sorted_classes(fr)
    mat = scaled_matrix(fr, "minmax").cache()
    cols = ["ne_d", "ne_id", "nn_d", "nn_id", "sumsq"] + [f"s{c}" for c in range(len(classes))]
    one = _collect(pair_stats(mat, classes, "gower", block_rows=10_000), cols)
    many = _collect(pair_stats(mat, classes, "gower", block_rows=37), cols)  # 14 blocks, 105 tiles
    assert one.keys() == many.keys()
    for k in one:
        np.testing.assert_allclose(np.array(one[k], float), np.array(many[k], float), rtol=1e-9)


def test_sil_tiled_equals_untiled(spark):
    fr = embeddings_frame(spark, SF0001)
    a = NB.ft_sil(NB.PairContext(fr, "euclidean", None, block_rows=10_000)).first()["value"]
    b = NB.ft_sil(NB.PairContext(fr, "euclidean", None, block_rows=50)).first()["value"]
    assert abs(a - b) < 1e-12


def test_knn_table_tiled(spark):
    fr = embeddings_frame(spark, SF0001)
    a = NB.knn_table(fr, 3, block_rows=10_000).orderBy("row_id", "rank").collect()
    b = NB.knn_table(fr, 3, block_rows=40).orderBy("row_id", "rank").collect()
    assert [(r.row_id, r.rank, r.nb_id) for r in a] == [(r.row_id, r.rank, r.nb_id) for r in b]
