"""Fitted phases applied to a file stream equal the batch apply."""

import uuid

from pyspark.sql import functions as F

from metaprism.operators import phases as P
from metaprism.session import ensure_checkpoint_dir
from metaprism.sources.tables import lineitem_frame
from metaprism.streaming.apply import apply_phases, write_available

from paths import SF0001


def test_stream_apply_equals_batch(spark):
    fr = lineitem_frame(spark, SF0001, with_cat=False)
    fitted = [P.fit_scale(fr, "min_max"), P.fit_normalise(fr, "cuadrado")]
    base = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    fr.df.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(fr.df.schema).parquet(f"{base}/in")
    write_available(apply_phases(stream, fr, fitted), f"{base}/out", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/out")
    want = fr
    for f in fitted:
        want = f.transform(want)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cols = key + list(fr.num)
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.df.select(*cols).collect())
    assert a == b
