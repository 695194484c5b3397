"""Registered queries: models (E), evaluation of clusterings (V5, V6),
landmarking (L), tree-shape features (M), relative landmarking (U1).

Learners are not reproducible in SQL; these are rows-only checks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..frame import Frame, union_all
from ..functions.numeric import sig, sql_sig
from ..functions.summaries import summarise
from ..operators import clustering as K
from ..operators import evaluation as V
from ..operators import landmarking as L
from ..operators import modelbased as MB
from ..operators import models as E
from ..operators import neighbourhood as NB
from ..operators import shaping as U
from ..operators import splits as R
from ..session import read_table
from ..sources.tables import embeddings_frame
from .extract import extract_from_model
from .registry import query, finish_long

CLASSIFIERS = ["logistic_regression", "linear_svc", "sgd_classifier", "ridge_classifier", "decision_tree",
               "random_forest", "gradient_boosting", "ada_boost", "gaussian_nb", "multinomial_nb",
               "mlp_classifier", "linear_discriminant_analysis", "quadratic_discriminant_analysis"]

#: Classifiers fitted at a time: their jobs are short and many.
PARALLEL_FITS = 4


def _split(fr: Frame):
    folded = R.kfold_stratified(fr, k=3).cache()
    train = fr.with_df(folded.where(F.col("fold") != 0))
    test = folded.where(F.col("fold") == 0)
    return train, test


def _scores(met):
    return tuple(met[c] for c in ("accuracy", "precision", "recall", "f1"))


@query("model_scores_classification", group="models")
def q_model_scores(spark, sf_dir):
    """Each classifier fitted with the library's defaults on folds 1-2 of EM,
    scored on fold 0; a model that fails (e.g. multinomial NB on negative values) gets the penalty
    metrics and status CRASH."""
    fr = embeddings_frame(spark, sf_dir)
    train, test = _split(fr)
    train.count()

    def score(name):
        if name == "knn":
            pred = NB.knn_vote(fr, k=5).join(fr.df.select("row_id", "y"), "row_id")
            return name, *_scores(V.classification_metrics(pred).first()), "OK"
        try:
            m = E.fit_classifier(name, train)
            return name, *_scores(V.classification_metrics(m.predict(test)).first()), "OK"
        except Exception:  # noqa: BLE001 - a failing learner is a result, not an error
            return name, *_scores(V.FAILED["clasificacion"]), "CRASH"
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(score), [*CLASSIFIERS, "knn"]))
    return spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, status string")


@query("model_scores_regression", group="models")
def q_model_regression(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.col("l_returnflag").alias("y"))
    fr = Frame(df=li, num=("l_quantity", "l_discount", "l_tax"), cat=(), label="y", row_id="row_id")
    folded = R.kfold_plain(fr, k=3).cache()
    train = fr.with_df(folded.where(F.col("fold") != 0))
    test = folded.where(F.col("fold") == 0)
    out = []
    for name in ["lineal", "ridge", "lasso", "elasticnet", "arbol_decision", "random_forest", "gradient_boosting"]:
        m = E.fit_regressor(name, train, "l_extendedprice")
        met = V.regression_metrics(m.predict(test).withColumnRenamed("l_extendedprice", "target"), y="target")
        out.append(met.select(F.lit(name).alias("model"), "*"))
    return union_all(out)


def _line_sql() -> str:
    """Closed forms of the penalised one-column fits."""
    def soft(by):
        return f"sign(sxy) * greatest(abs(sxy) / n - {by}, 0)"

    slopes = {"lineal": "sxy / sxx", "ridge": "sxy / (sxx + 1)", "lasso": f"{soft(1.0)} / (sxx / n)",
              "elasticnet": f"{soft(0.5)} / (sxx / n + 0.5)"}
    parts = [f"SELECT '{m}' AS model, {sql_sig(e, 6)} AS slope, {sql_sig(f'my - ({e}) * mx', 6)} AS intercept FROM s" for m, e in slopes.items()]
    return ("WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, "
            "covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx FROM lineitem) "
            + " UNION ALL ".join(parts))


@query("regression_line", _line_sql(), group="models")
def q_regression_line(spark, sf_dir):
    """E14 on one column: slope and intercept of l_extendedprice on l_quantity."""
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    fr = Frame(df=li, num=("l_quantity",), cat=(), label=None, row_id=None)
    rows = []
    for name in ("lineal", "ridge", "lasso", "elasticnet"):
        m = E.fit_regressor(name, fr, "l_extendedprice").model
        rows.append((name, float(m.coefficients[0]), float(m.intercept)))
    return (spark.createDataFrame(rows, "model string, slope double, intercept double")
            .select("model", sig(F.col("slope"), 6).alias("slope"), sig(F.col("intercept"), 6).alias("intercept")))


@query("clustering_models", group="models")
def q_clustering_models(spark, sf_dir):
    """k-means (k=8) and spectral (power iteration on the k-NN graph) on EM:
    cluster metrics with the predicted label (V5) and cluster->class match
    accuracy (V6)."""
    fr = embeddings_frame(spark, sf_dir)
    km = E.fit_kmeans(fr, k=8).predict(fr.df).select("row_id", "pred")
    sp = E.spectral_clustering(fr, k=8)
    out = []
    for name, pred in (("kmeans", km), ("spectral_clustering", sp)):
        lab = fr.df.join(pred, "row_id")
        pf = Frame(df=lab.drop("y").withColumnRenamed("pred", "y"), num=fr.num, cat=(), label="y", row_id="row_id")
        ctx = NB.PairContext(pf, "euclidean", None, want=NB.CLUSTERING)
        sil = NB.ft_sil(ctx).first()["value"]
        ch = K.ft_ch(pf).first()["value"]
        db = K.ft_vdb(pf).first()["value"]
        mapping = V.cluster_class_match(lab.select(F.col("pred").alias("cluster"), "y"))
        mapped = lab.join(mapping, lab.pred == mapping.cluster).select("y", F.col("mapped").alias("pred"))
        acc = V.classification_metrics(mapped).first()["accuracy"]
        out.append((name, sil, ch, db, acc))
    return spark.createDataFrame(out, "model string, silhouette double, calinski double, davies double, match_accuracy double")


@query("tree_shape_features", group="model-based")
def q_tree_shape(spark, sf_dir):
    t = MB.TreeContext(embeddings_frame(spark, sf_dir))
    return finish_long(union_all([fn(t) for fn in MB.FEATURES.values()]))


@query("extract_from_model", group="model-based")
def q_extract_from_model(spark, sf_dir):
    """Tree shape of a model that was fitted before, from the model alone."""
    fr = embeddings_frame(spark, sf_dir)
    model, classes = MB.fit_tree(fr)
    out = extract_from_model(model, spark, attrs=fr.num, classes=classes)
    return out.select("name", sig(F.col("value")).alias("value"))


@query("landmarking", group="landmarking")
def q_landmarking(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    return finish_long(union_all([fn(fr) for fn in L.FEATURES.values()]))


@query("relative_landmarking", group="landmarking")
def q_relative(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    names = ["one_nn", "linear_discr", "naive_bayes"]
    long = union_all([L.FEATURES[n](fr) for n in names])
    res = summarise(long, ("mean", "sd"), vector_features=set(names))
    return U.relative_rank(res, names).select("name", sig(F.col("value")).alias("value"))


@query("dbscan_clusters", group="models")
def q_dbscan(spark, sf_dir):
    """DBSCAN (eps 0.5, min_samples 5) on the standardised embedding columns;
    checked against brute force in tests/test_dbscan.py."""
    from ..operators import phases as P
    fr = embeddings_frame(spark, sf_dir)
    z = P.standardise_matrix(fr).transform(fr)
    return E.dbscan(z, eps=0.5, min_samples=5)
