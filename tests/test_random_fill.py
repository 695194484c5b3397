"""Random fills where most cells are kept: kept cells do not meet in one task."""

import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.operators import phases as P


@pytest.mark.parametrize("limit", [0, 10_000])
def test_kept_cells_are_spread(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_LEVELS", limit)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "-1")):
            spark.conf.set(c, v)
        df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), F.col("id") % 300)).alias("s"))
        fr = Frame(df=df, num=(), cat=("s",), label=None, row_id="row_id")
        out = P.fit_impute_str(fr, "aleatorio", seed=5).transform(fr).df
        rows = out.select("row_id", "s", F.spark_partition_id().alias("p")).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(rows) == 4000 and all(r["s"] for r in rows)
    assert all(r["s"] == f"v{r['row_id'] % 300}" for r in rows if r["row_id"] % 10)
    sizes = {}
    for r in rows:
        sizes[r["p"]] = sizes.get(r["p"], 0) + 1
    assert max(sizes.values()) < 0.4 * len(rows)
