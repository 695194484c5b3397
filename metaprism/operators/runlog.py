"""Pipeline configurations, phase chains and the step-by-step run log
(R6, P38, Q1-Q5).

A run is a driver loop of Spark jobs: folds are one DataFrame with a ``fold``
column; every phase is fit on the fold's train rows (small aggregate actions)
and applied to train and validation as expressions; models are Spark ML or
aggregate-based; the log rows are built with window functions over the
(config, model, step) table and appended as partitioned parquet.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame
from . import evaluation as V
from . import phases as P

# fixed values: the phase order of a pipeline and the options of each phase
# (None = pass-through), then the model lists per task
PHASES: list[tuple[str, list[str | None]]] = [
    ("tratar_duplicados", ["eliminar", None]),
    ("codificar_variables_binarias", ["label_encoding", None]),
    ("tratar_faltantes_numericos", ["aleatorio", "eliminar", "media", "media_geometrica", "mediana", "moda", None]),
    ("tratar_faltantes_strings", ["aleatorio", "eliminar", "etiqueta_desconocido", "moda"]),
    ("codificar_variables_categoricas_rango_bajo", ["label_encoding", None, "one_hot_encoding"]),
    ("codificar_variables_categoricas_rango_medio", ["eliminar_variable", "frequency_encoding"]),
    ("codificar_variables_categoricas_rango_alto", ["eliminar_columna"]),
    ("tratar_outliers_numericos", ["aleatorio", "eliminar", "media", "media_geometrica", "mediana", "moda", None]),
    ("escalar_datos_numericos", ["max_abs_scaler", "min_max", None, "robust_scaler", "standard_scaler"]),
    ("normalizar_datos_numericos", ["box_cox", "cuadrado", "inverso", "ln", None, "sqrt", "z_score"]),
    ("crear_nueva_variable", ["llm_deepseek-r1:8b", "llm_llama3.1:8b", "llm_qwen2.5-coder:7b", None]),
    ("seleccionar_variables", ["llm_deepseek-r1:8b", "llm_llama3.1:8b", "llm_qwen2.5-coder:7b", "mutual_info_25",
                               "mutual_info_50", "mutual_info_75", None, "pca_90", "pca_95", "pca_99",
                               "select_from_model", "umap_20", "umap_50", "umap_80"]),
]
MODELS: dict[str, list[str]] = {
    "clasificacion": ["logistic_regression", "sgd_classifier", "ridge_classifier", "decision_tree", "random_forest",
                      "gradient_boosting", "hist_gradient_boosting", "ada_boost", "svc", "linear_svc", "knn",
                      "gaussian_nb", "multinomial_nb", "mlp_classifier", "linear_discriminant_analysis",
                      "quadratic_discriminant_analysis"],
    "regresion": ["lineal", "ridge", "lasso", "elasticnet", "svr", "knn", "arbol_decision", "random_forest",
                  "gradient_boosting", "ada_boost", "mlp_regressor"],
    "clustering": ["kmeans", "dbscan", "agglomerative_clustering", "mean_shift", "spectral_clustering", "birch"],
}
EXTERNAL_PREFIX = "llm"          # options needing an external chat service
NOT_BUILT = {"svc", "svr", "mlp_regressor", "agglomerative_clustering", "mean_shift", "birch",
             "umap_20", "umap_50", "umap_80"}
NOT_BUILT_FOR = {"regresion": {"ada_boost"}}  # built for classification only
ADVISER_VECTOR = [0.0, 0.0, 0.0, 1.0]  # the last position: no external adviser
#: Models of a fold fitted at a time: their jobs are short and many.
PARALLEL_FITS = 4


def option_index(spark: SparkSession) -> DataFrame:
    """Q1: (key, option, pos) for every phase option then every model."""
    rows, pos = [], 0
    for phase, opts in PHASES:
        for o in opts:
            rows.append((phase, o, pos))
            pos += 1
    for task, models in MODELS.items():
        for m in models:
            rows.append((f"modelos_{task}", m, pos))
            pos += 1
    return spark.createDataFrame(rows, "key string, option string, pos int")


def state_size() -> int:
    return sum(len(o) for _, o in PHASES) + sum(len(m) for m in MODELS.values())


def sample_pipelines(spark: SparkSession, n: int, task: str, seed: int = 42, allow_none: bool = True,
                     model_share: float = 0.7) -> DataFrame:
    """(num_pipeline, step, phase, option) plus (num_pipeline, models).
    One option per phase chosen by a hash of (config, phase, seed) among the
    allowed options; models: int(share * k) of the task's built models, ranked
    by a hash (without replacement)."""
    opts = [(i, ph, o) for i, (ph, os_) in enumerate(PHASES) for o in os_
            if (allow_none or o is not None) and not (o or "").startswith(EXTERNAL_PREFIX) and o not in NOT_BUILT]
    table = spark.createDataFrame(opts, "step int, phase string, option string")
    ranked = (table.withColumn("cfg", F.explode(F.sequence(F.lit(1), F.lit(n))))
              .withColumn("h", F.xxhash64("cfg", "phase", "option", F.lit(seed))))
    w = Window.partitionBy("cfg", "step").orderBy("h")  # a handful of options per (config, phase)
    chosen = ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select(
        F.col("cfg").alias("num_pipeline"), "step", "phase", "option")
    models = [m for m in MODELS[task] if m not in NOT_BUILT | NOT_BUILT_FOR.get(task, set())]
    k = max(1, int(model_share * len(models)))
    mt = spark.createDataFrame([(m,) for m in models], "model string").withColumn(
        "cfg", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("h", F.xxhash64("cfg", "model", F.lit(seed + 1)))
    wm = Window.partitionBy("cfg").orderBy("h")  # one row per built model per config
    picked = mt.withColumn("r", F.row_number().over(wm)).where(F.col("r") <= k).select(
        F.col("cfg").alias("num_pipeline"), F.col("r").alias("num_modelo"), "model")
    return chosen, picked


def step_states(steps: DataFrame, models: DataFrame, task: str, failed_step: DataFrame | None = None) -> DataFrame:
    """Q2: one row per (pipeline, model, paso_t) with the cumulative 0/1 state
    vector after that step; the model's own position is switched on in the
    final step.  ``steps``: (num_pipeline, step, phase, option)."""
    spark = steps.sparkSession
    idx = option_index(spark)
    size = state_size()
    s = steps.join(idx, (steps.phase == idx.key) & (steps.option.eqNullSafe(idx.option)), "left") \
        .select("num_pipeline", "step", "phase", steps.option.alias("option"), "pos")
    runs = s.join(models, "num_pipeline")
    mi = idx.where(F.col("key") == f"modelos_{task}").select(F.col("option").alias("model"), F.col("pos").alias("mpos"))
    final = models.join(mi, "model").select("num_pipeline", "num_modelo", "model",
                                            F.lit(len(PHASES)).alias("step"), F.lit("FINAL").alias("phase"),
                                            F.lit(None).cast("string").alias("option"), F.col("mpos").alias("pos"))
    allsteps = runs.select("num_pipeline", "num_modelo", "model", "step", "phase", "option", "pos").unionByName(final)
    w = (Window.partitionBy("num_pipeline", "num_modelo").orderBy("step")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most 13 steps per run
    on = allsteps.withColumn("on", F.collect_set("pos").over(w))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("on", i).cast("double"))
    return on.select("num_pipeline", "num_modelo", "model", F.col("step").alias("paso_t"), "phase", "option",
                     vec.alias("estado"))


def trajectory_log(states: DataFrame, dataset: str, task: str, mtf: dict, mtf_vector: list[float],
                   pipelines_json: DataFrame, metrics: DataFrame, times: DataFrame) -> DataFrame:
    """Q3: run-log rows: state = mtf ++ step state ++ adviser, next state by
    ``lead``, action ``phase_option`` or FINAL, metrics/time/done on the last
    step.  ``metrics``: (num_pipeline, num_modelo, metricas json);
    ``times``: (num_pipeline, num_modelo, tiempo)."""
    pre = F.array(*[F.lit(float(v)) for v in mtf_vector])
    adv = F.array(*[F.lit(v) for v in ADVISER_VECTOR])
    w = Window.partitionBy("num_pipeline", "num_modelo").orderBy("paso_t")  # at most 13 steps per run
    last = F.col("paso_t") == F.max("paso_t").over(Window.partitionBy("num_pipeline", "num_modelo"))
    st = states.withColumn("estado_actual", F.concat(pre, "estado", adv)) \
        .withColumn("estado_siguiente", F.lead("estado_actual").over(w)) \
        .withColumn("accion", F.when(F.col("phase") == "FINAL", F.lit("FINAL"))
                    .otherwise(F.concat_ws("_", "phase", F.coalesce("option", F.lit("None"))))) \
        .withColumn("is_last", last)
    out = st.join(pipelines_json, "num_pipeline").join(metrics, ["num_pipeline", "num_modelo"], "left") \
        .join(times, ["num_pipeline", "num_modelo"], "left")
    return out.select(
        F.lit(dataset).alias("nombre_dataset"), F.col("num_pipeline").cast("int"), F.col("num_modelo").cast("int"),
        F.lit(json.dumps(mtf)).alias("mtf_json"), "pipeline_json", F.col("paso_t").cast("int"),
        "estado_actual", "accion", "estado_siguiente", F.lit(None).cast("string").alias("llm_seleccionado"),
        F.col("model").alias("nombre_modelo"), F.lit(task).alias("tipo_tarea"),
        F.when(F.col("is_last"), F.col("metricas")).alias("metricas"),
        F.col("is_last").cast("int").alias("completado"),
        F.when(F.col("is_last"), F.col("tiempo")).cast("double").alias("tiempo_ejecucion"))


def trajectory_log_failed(steps: DataFrame, failed: DataFrame, dataset: str, task: str, mtf: dict,
                          mtf_vector: list[float]) -> DataFrame:
    """Q4: runs that crashed in a phase: steps cut at the failing phase, model
    'modelo_no_ejecutado', action ``phase-option``, status CRASH, time -1.
    ``failed``: (num_pipeline, failed_step, error, pipeline_json)."""
    cut = steps.join(failed, "num_pipeline").where(F.col("step") <= F.col("failed_step"))
    idx = option_index(steps.sparkSession)
    size = state_size()
    s = cut.join(idx, (cut.phase == idx.key) & (cut.option.eqNullSafe(idx.option)), "left")
    w = Window.partitionBy("num_pipeline").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = s.withColumn("on", F.collect_set("pos").over(w))  # at most 12 steps per run
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("on", i).cast("double"))
    pre = F.array(*[F.lit(float(v)) for v in mtf_vector])
    adv = F.array(*[F.lit(v) for v in ADVISER_VECTOR])
    wl = Window.partitionBy("num_pipeline").orderBy("step")
    is_last = F.col("step") == F.col("failed_step")
    st = on.withColumn("estado_actual", F.concat(pre, vec, adv)).withColumn("estado_siguiente", F.lead("estado_actual").over(wl))
    return st.select(
        F.lit(dataset).alias("nombre_dataset"), F.col("num_pipeline").cast("int"), F.lit(-1).alias("num_modelo"),
        F.lit(json.dumps(mtf)).alias("mtf_json"), "pipeline_json", F.col("step").cast("int").alias("paso_t"),
        "estado_actual", F.concat_ws("-", "phase", F.coalesce(cut.option, F.lit("None"))).alias("accion"),
        "estado_siguiente", F.lit(None).cast("string").alias("llm_seleccionado"),
        F.lit("modelo_no_ejecutado").alias("nombre_modelo"), F.lit(task).alias("tipo_tarea"),
        F.when(is_last, F.to_json(F.struct(F.lit("CRASH").alias("estado"), F.col("error").alias("error")))).alias("metricas"),
        is_last.cast("int").alias("completado"), F.when(is_last, F.lit(-1.0)).alias("tiempo_ejecucion"))


# ------------------------------------------------------------ P38 phase chain
def fit_phase(phase: str, option: str | None, train: Frame, task: str):
    """Fit one phase on train; returns a transform(Frame) -> Frame."""
    if option is None:
        return lambda fr: fr
    if option.startswith(EXTERNAL_PREFIX) or option in NOT_BUILT:
        raise ValueError(f"option {option!r} of {phase} is not built")
    if phase == "tratar_duplicados":
        return lambda fr: P.dedup_rows(fr)
    if phase == "codificar_variables_binarias":
        return P.fit_binary_label(train).transform
    if phase == "tratar_faltantes_numericos":
        return P.drop_null_num if option == "eliminar" else P.fit_impute_num(train, option).transform
    if phase == "tratar_faltantes_strings":
        return P.drop_null_str if option == "eliminar" else P.fit_impute_str(train, option).transform
    if phase == "codificar_variables_categoricas_rango_bajo":
        return P.fit_low_card(train, option).transform
    if phase == "codificar_variables_categoricas_rango_medio":
        return P.fit_mid_card(train, option).transform
    if phase == "codificar_variables_categoricas_rango_alto":
        return P.fit_high_card(train).transform
    if phase == "tratar_outliers_numericos":
        return P.fit_outliers(train, option).transform
    if phase == "escalar_datos_numericos":
        return P.fit_scale(train, option).transform
    if phase == "normalizar_datos_numericos":
        return P.fit_normalise(train, option).transform
    if phase == "seleccionar_variables":
        if option.startswith("mutual_info_"):
            share = int(option.rsplit("_", 1)[1]) / 100.0
            return P.fit_select_mutual_info(train, share, task).transform
        if option.startswith("pca_"):
            return P.fit_pca(train, int(option.rsplit("_", 1)[1]) / 100.0).transform
        if option == "select_from_model":
            return P.fit_select_by_forest(train, task).transform
    return lambda fr: fr


def phase_chain(train: Frame, valid: Frame, pipeline: list[tuple[str, str | None]], task: str):
    """Fit each phase on the current train, apply to train and valid, in
    the fixed order.  Returns (train, valid, failed_phase or None, error)."""
    for phase, option in pipeline:
        try:
            tf = fit_phase(phase, option, train, task)
            train, valid = tf(train), tf(valid)
        except Exception as e:  # noqa: BLE001 - a failing phase ends the run, as a result row
            return train, valid, phase, f"{type(e).__name__}: {e}"[:500]
    return train, valid, None, None


def run_experiment(fr: Frame, task: str = "clasificacion", n_configs: int = 2, n_folds: int = 3, seed: int = 42,
                   model_params: dict | None = None, max_models: int | None = None) -> DataFrame:
    """Q5: features, sampled configurations, folds, phases, models, fold
    averages, run log.  A driver loop of Spark jobs; every heavy step is a
    Spark job over the whole table."""
    from ..plans.extract import extract
    from . import shaping as Sh
    from . import splits
    from .models import fit_classifier, fit_regressor
    from .neighbourhood import knn_predict, knn_regress
    spark = fr.spark
    mf = Sh.sanitise_values(extract(fr, groups=("general", "statistical"))).collect()  # ~100 named values
    mtf = {r["name"]: r["value"] for r in mf}
    mtf_vector = [r["value"] for r in mf] + [1.0 if t == task else 0.0 for t in ("clasificacion", "regresion", "clustering")]
    steps, models = sample_pipelines(spark, n_configs, task, seed)
    cfg_steps: dict[int, list] = {}
    for r in steps.orderBy("num_pipeline", "step").collect():  # n_configs x 12 rows
        cfg_steps.setdefault(r["num_pipeline"], []).append((r["step"], r["phase"], r["option"]))
    cfg_models: dict[int, list] = {}
    for r in models.orderBy("num_pipeline", "num_modelo").collect():
        cfg_models.setdefault(r["num_pipeline"], []).append((r["num_modelo"], r["model"]))
    folded = (splits.kfold_stratified(fr, n_folds) if task == "clasificacion" else splits.kfold_plain(fr, n_folds)).cache()
    metric_rows, time_rows, failed_rows, pj_rows = [], [], [], []
    for cfg, st in cfg_steps.items():
        pipeline = [(ph, op) for _, ph, op in st]
        pj_rows.append((cfg, json.dumps({ph: op for ph, op in pipeline})))
        mods = cfg_models.get(cfg, [])[:max_models] if max_models else cfg_models.get(cfg, [])
        per_model: dict[int, list] = {m: [] for m, _ in mods}
        spent: dict[int, float] = {m: 0.0 for m, _ in mods}
        crashed = None
        for f in range(n_folds):
            t0 = time.time()
            tr = fr.with_df(folded.where(F.col("fold") != f).drop("fold"))
            va = fr.with_df(folded.where(F.col("fold") == f).drop("fold"))
            tr, va, bad, err = phase_chain(tr, va, pipeline, task)
            prep = time.time() - t0
            if bad is not None:
                crashed = ([i for i, (ph, _) in enumerate(pipeline) if ph == bad][0], err)
                break
            tr = tr.with_df(tr.df.cache())

            def fold_metrics(mod, tr=tr, va=va, prep=prep):
                m, name = mod
                t1 = time.time()
                try:
                    if name == "knn":
                        pred = knn_regress(tr, va.df, 5) if task == "regresion" else knn_predict(tr, va.df, 5)
                    elif task == "regresion":
                        pred = fit_regressor(name, tr, tr.label).predict(va.df)
                    else:
                        pred = fit_classifier(name, tr, **(model_params or {}).get(name, {})).predict(va.df)
                    ycol = F.col(tr.label).cast("string") if task == "clasificacion" else F.col(tr.label)
                    pred = pred.select(ycol.alias("y"), "pred")
                    met = (V.classification_metrics(pred) if task == "clasificacion"
                           else V.regression_metrics(pred)).first().asDict()
                    if task == "clasificacion":
                        met = {"accuracy": met["accuracy"], "precision": met["precision"],
                               "recall": met["recall"], "f1": met["f1"]}
                except Exception:  # noqa: BLE001 - failed fold: penalty values
                    met = None
                return m, met, prep + time.time() - t1
            with ThreadPoolExecutor(PARALLEL_FITS) as pool:
                for m, met, sec in pool.map(inheritable_thread_target(spark)(fold_metrics), mods):
                    per_model[m].append(met)
                    spent[m] += sec
            tr.df.unpersist()
        if crashed is not None:
            failed_rows.append((cfg, crashed[0], crashed[1]))
            continue
        for m, name in mods:
            pen = V.FAILED[task]
            vals = [x if x is not None else pen for x in per_model[m]]
            avg = {k: sum(v[k] for v in vals) / len(vals) for k in pen}
            if any(x is None for x in per_model[m]):
                avg["estado"] = "CRASH"
            metric_rows.append((cfg, m, json.dumps(avg)))
            time_rows.append((cfg, m, spent[m]))
    pj = spark.createDataFrame(pj_rows, "num_pipeline int, pipeline_json string")
    metrics = spark.createDataFrame(metric_rows, "num_pipeline int, num_modelo int, metricas string")
    times = spark.createDataFrame(time_rows, "num_pipeline int, num_modelo int, tiempo double")
    ok_cfg = [c for c in cfg_steps if c not in {r[0] for r in failed_rows}]
    ok_models = models.where(F.col("num_pipeline").isin(ok_cfg)) if ok_cfg else models.limit(0)
    if max_models:
        ok_models = ok_models.where(F.col("num_modelo") <= max_models)
    states = step_states(steps.where(F.col("num_pipeline").isin(ok_cfg)) if ok_cfg else steps.limit(0), ok_models, task)
    log = trajectory_log(states, fr.name, task, mtf, mtf_vector, pj, metrics, times)
    if failed_rows:
        fl = spark.createDataFrame(failed_rows, "num_pipeline int, failed_step int, error string").join(pj, "num_pipeline")
        log = log.unionByName(trajectory_log_failed(steps, fl, fr.name, task, mtf, mtf_vector))
    return log
