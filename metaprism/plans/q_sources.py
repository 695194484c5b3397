"""Registered queries: file scans and sinks (S1-S7) on files that Spark
writes from the given tables into the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frame import Frame, union_all
from ..functions.numeric import sig, sql_sig
from ..functions.summaries import summarise
from ..operators import general as G
from ..session import ensure_checkpoint_dir, read_table
from ..sources import files as S
from ..sources.tables import lineitem_frame
from .registry import query


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}"


@query("scan_csv",
       f"SELECT l_returnflag AS y, count(*) AS n, {sql_sig('avg(l_quantity)')} AS mean_quantity FROM lineitem GROUP BY 1",
       group="sources")
def q_scan_csv(spark, sf_dir):
    path = _scratch(spark, "lineitem_csv")
    read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_linestatus",
                                                 "l_returnflag").write.option("header", True).csv(path)
    fr = S.scan_csv(spark, path, target="l_returnflag",
                    schema="l_orderkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_returnflag string")
    return fr.df.groupBy(F.col(fr.label).alias("y")).agg(F.count(F.lit(1)).alias("n"),
                                                         sig(F.avg("l_quantity")).alias("mean_quantity"))


@query("scan_manifest",
       "SELECT lower(strip_accents(trim(n_name))) AS tarea, CAST(n_nationkey AS BIGINT) AS task_id FROM nation",
       group="sources")
def q_scan_manifest(spark, sf_dir):
    path = _scratch(spark, "manifest")
    read_table(spark, sf_dir, "nation").select("n_name", "n_nationkey").write.csv(path)
    return S.scan_manifest(spark, path)


@query("scan_id_list", "SELECT 'clasificacion' AS tarea, c_custkey AS task_id FROM customer", group="sources")
def q_scan_id_list(spark, sf_dir):
    path = _scratch(spark, "clasificacion_task_ids")
    # every tenth line blank (must be skipped by the scan)
    cu = read_table(spark, sf_dir, "customer")
    lines = cu.select(F.explode(F.array(F.col("c_custkey").cast("string"),
                                        F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")))).alias("value"))
    lines.where(F.col("value").isNotNull()).write.text(path)
    return S.scan_id_list(spark, path)


@query("scan_arff",
       f"SELECT p_brand AS cls, count(*) AS n, {sql_sig('avg(p_size)')} AS mean_size, "
       f"{sql_sig('avg(p_retailprice)')} AS mean_price, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand",
       group="sources")
def q_scan_arff(spark, sf_dir):
    path = _scratch(spark, "part_arff")
    pt = read_table(spark, sf_dir, "part")
    types = [r["p_type"] for r in pt.select("p_type").distinct().orderBy("p_type").collect()]  # nominal levels (checked small)
    brands = [r["p_brand"] for r in pt.select("p_brand").distinct().orderBy("p_brand").collect()]
    S.write_arff(pt.select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_type", "p_brand"),
                 path, "part", {"p_type": types, "p_brand": brands})
    fr = S.scan_arff(spark, f"{path}/data", header_path=f"{path}/header")
    S.align_xy(fr)
    return fr.df.groupBy(F.col(fr.label).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), sig(F.avg("p_size")).alias("mean_size"),
        sig(F.avg("p_retailprice")).alias("mean_price"), F.count_distinct("p_type").alias("types"))


@query("sink_metafeatures", group="sources")
def q_sink_metafeatures(spark, sf_dir):
    fr = lineitem_frame(spark, sf_dir)
    res = summarise(union_all([fn(fr) for fn in G.FEATURES.values()]), ("mean", "sd"), vector_features={"freq_class"})
    path = _scratch(spark, "metafeatures")
    S.sink_metafeatures(S.metafeature_record("lineitem", res), path)
    back = spark.read.parquet(path)
    return back.select("dataset", F.explode("mtf").alias("name", "value"))
