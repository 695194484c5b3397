"""Registered queries: pipeline runs and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phases as P
from ..operators import runlog as Q
from ..sources import files as S
from ..sources.tables import embeddings_frame
from .q_sources import _scratch
from .registry import query

#: Configurations of a dataset (the reference's NUM_PIPELINES_POR_DATASET).
N_CONFIGS = 10


@query("run_experiment", group="runs")
def q_run_experiment(spark, sf_dir):
    """Ten sampled configurations on EM: 3 stratified folds, the phase chain
    fitted per fold, all sampled models of each configuration with the
    library's defaults, fold-averaged metrics, and the step log appended to a
    parquet sink."""
    fr = embeddings_frame(spark, sf_dir)
    log = Q.run_experiment(fr, "clasificacion", n_configs=N_CONFIGS, n_folds=3)
    path = _scratch(spark, "run_log")
    S.sink_run_log(log, path)
    return spark.read.parquet(path).select("nombre_dataset", "num_pipeline", "num_modelo", "paso_t", "accion",
                                           "nombre_modelo", "completado", F.size("estado_actual").alias("state_len"),
                                           "metricas")


@query("select_pca", group="phases")
def q_select_pca(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    f = P.fit_pca(fr, 0.95)
    out = f.transform(fr)
    return out.df.select("row_id", *out.num)


@query("select_by_forest", group="phases")
def q_select_forest(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    f = P.fit_select_by_forest(fr, trees=100)
    return spark.createDataFrame([(c,) for c in f.params["keep"]], "kept string")


@query("select_mutual_info", group="phases")
def q_select_mi(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    out = P.fit_select_mutual_info(fr, 0.5).transform(fr)
    return out.df.select("row_id", *out.attrs)
