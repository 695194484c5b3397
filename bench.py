"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metaprism.session import get_spark  # noqa: E402
from metaprism.plans import load_all  # noqa: E402
from metaprism.plans.extract import extract  # noqa: E402
from metaprism.sources.tables import lineitem_frame  # noqa: E402

HEADLINE = [
    "class_profile", "stat_column_features", "stat_mad", "stat_t_mean", "general", "info_theory",
    "two_itemset", "summary_functions", "clustering_centroid", "complexity_overlap",
    "clustering_distances", "complexity_neighbourhood", "concept", "knn_table",
    "impute_num_media", "encode_low_card_onehot", "encode_mid_card_freq", "scale_robust_scaler",
    "replace_outliers_mediana", "dedup_rows", "mutual_info_scores",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    reg = load_all()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    # the reference's main workload: default extraction (general, statistical,
    # info-theory) summarised by mean and sd over the lineitem profile
    t0 = time.time()
    extract(lineitem_frame(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    times["extract_default"] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
