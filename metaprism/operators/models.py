"""Models (E1-E18) as Spark ML estimators or aggregate-based classifiers.

Every model has the same shape: ``fit(train: Frame) -> Fitted`` and
``Fitted.predict(df) -> df + pred``.  MLlib estimators are distributed
already; discriminant analysis and ridge-classification are built from one
grouped moments pass plus d x d algebra, then a score expression.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Callable

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import classification as MC
from pyspark.ml import clustering as MK
from pyspark.ml import regression as MR
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, keyed
from ..session import written
from . import moments as Mo

FEAT = "_features"
LBL = "_label"


@dataclass
class FittedModel:
    name: str
    predict: Callable[[DataFrame], DataFrame]
    model: Any = None
    classes: list | None = None


def assemble(df: DataFrame, cols) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=FEAT, handleInvalid="keep").transform(df)


def _indexed(fr: Frame, classes: list[str]) -> DataFrame:
    """Label index = position of the label among the sorted classes."""
    idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return assemble(fr.df, fr.num).withColumn(LBL, idx[fr.y()])


def _decode(classes):
    arr = F.array(*[F.lit(c) for c in classes])
    return lambda col: F.get(arr, col.cast("int"))


#: Rows of a task when a classifier is fitted.
FIT_ROWS = 20_000


def _packed(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows in as many partitions as they fill: every partition costs a
    fit one task a step and, for trees, the statistics of all open nodes."""
    return df.coalesce(max(1, -(-n // FIT_ROWS)))


def class_list(fr: Frame) -> list[str]:
    from .pairs import sorted_classes
    return sorted_classes(fr)


# The defaults of the reference's learners: penalty C = 1 spread over n rows,
# no standardisation; boosting of depth 3; forests and trees as deep as MLlib goes.  Deep ones keep each
# row's node, or every pass would send the whole tree to all tasks.
MLLIB_CLASSIFIERS = {
    "logistic_regression": lambda n, seed: MC.LogisticRegression(
        family="multinomial", maxIter=100, regParam=1.0 / n, standardization=False),
    "linear_svc": lambda n, seed: MC.OneVsRest(
        classifier=MC.LinearSVC(maxIter=100, regParam=1.0 / n, standardization=False), parallelism=8),
    "sgd_classifier": lambda n, seed: MC.OneVsRest(
        classifier=MC.LinearSVC(maxIter=100, regParam=1e-4, standardization=False), parallelism=8),
    "decision_tree": lambda n, seed: MC.DecisionTreeClassifier(maxDepth=30, seed=seed, cacheNodeIds=True),
    "random_forest": lambda n, seed: MC.RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed, cacheNodeIds=True),
    "gradient_boosting": lambda n, seed: MC.OneVsRest(
        classifier=MC.GBTClassifier(maxIter=100, maxDepth=3, seed=seed), parallelism=8),
    "hist_gradient_boosting": lambda n, seed: MC.OneVsRest(
        classifier=MC.GBTClassifier(maxIter=100, maxDepth=5, maxBins=255, seed=seed), parallelism=8),
    "gaussian_nb": lambda n, seed: MC.NaiveBayes(modelType="gaussian"),
    "multinomial_nb": lambda n, seed: MC.NaiveBayes(modelType="multinomial"),
}


def fit_classifier(name: str, fr: Frame, seed: int = 42, **params) -> FittedModel:
    classes = class_list(fr)
    dec = _decode(classes)
    if name in MLLIB_CLASSIFIERS or name == "mlp_classifier":
        est = (MC.MultilayerPerceptronClassifier(layers=[len(fr.num), 100, len(classes)], seed=seed, maxIter=200)
               if name == "mlp_classifier" else MLLIB_CLASSIFIERS[name](max(fr.count(), 1), seed))
        est = est.setFeaturesCol(FEAT).setLabelCol(LBL).setPredictionCol("_p")
        inner = est.getClassifier() if isinstance(est, MC.OneVsRest) else est
        for k, v in params.items():
            if inner.hasParam(k):
                inner._set(**{k: v})
        data = _packed(_indexed(fr, classes), fr.count()).cache()
        try:
            model = est.fit(data)
        finally:
            data.unpersist()

        def predict(df: DataFrame) -> DataFrame:
            out = model.transform(assemble(df, fr.num))
            keep = [c for c in df.columns]
            return out.select(*keep, dec(F.col("_p")).alias("pred"))
        return FittedModel(name, predict, model, classes)
    if name in ("linear_discriminant_analysis", "quadratic_discriminant_analysis"):
        return _fit_discriminant(fr, name, quadratic=name.startswith("quadratic"))
    if name == "ridge_classifier":
        return _fit_ridge_classifier(fr, params.get("alpha", 1.0))
    if name == "ada_boost":
        return _fit_adaboost(fr, params.get("n_estimators", 50), seed)
    if name == "knn":
        raise ValueError("k-NN prediction runs on the pair kernel: neighbourhood.knn_vote")
    raise ValueError(f"unknown classifier {name}")


def _fit_discriminant(fr: Frame, name: str, quadratic: bool, reg: float = 0.0) -> FittedModel:
    """LDA / QDA from class moments (one grouped pass); prediction = argmax of
    the Gaussian log-score, evaluated as a column expression."""
    sc = Mo.class_scatter(fr)
    k, d = len(sc.classes), len(sc.cols)
    pri = np.log(sc.counts / sc.n)
    x = [F.col(c).cast("double") for c in sc.cols]
    scores = []
    if quadratic:
        for c in range(k):
            S = np.nan_to_num(sc.covs[c]) + reg * np.eye(d)
            P = np.linalg.pinv(S)
            sign, logdet = np.linalg.slogdet(S)
            logdet = logdet if sign > 0 else 0.0
            mu = sc.means[c]
            dev = [xi - float(mu[i]) for i, xi in enumerate(x)]
            quad = sum(dev[i] * dev[j] * float(P[i, j]) for i in range(d) for j in range(d))
            scores.append(F.lit(float(pri[c] - 0.5 * logdet)) - 0.5 * quad)
    else:
        W = sc.within() / max(sc.n - k, 1.0)
        P = np.linalg.pinv(W)
        for c in range(k):
            mu = sc.means[c]
            w = P @ mu
            b = float(-0.5 * mu @ P @ mu + pri[c])
            scores.append(sum(float(w[i]) * x[i] for i in range(d)) + F.lit(b))
    def predict(df: DataFrame) -> DataFrame:
        # scores as columns first: the argmax then refers to them by name
        with_s = df.withColumns({f"_s{c}": scores[c] for c in range(k)})
        return with_s.withColumn("pred", _argmax_label([f"_s{c}" for c in range(k)], sc.classes)).drop(
            *[f"_s{c}" for c in range(k)])
    return FittedModel(name, predict, None, sc.classes)


def _argmax_label(score_cols: list[str], classes: list[str]):
    """Label of the largest score column; the first class wins ties."""
    best = F.greatest(*[F.col(c) for c in score_cols]) if len(score_cols) > 1 else F.col(score_cols[0])
    pred = F.lit(None).cast("string")
    for c in reversed(range(len(classes))):
        pred = F.when(F.col(score_cols[c]) == best, F.lit(classes[c])).otherwise(pred)
    return pred


def _fit_ridge_classifier(fr: Frame, alpha: float) -> FittedModel:
    """Least squares on +-1 targets with L2 (one regression per class)."""
    classes = class_list(fr)
    n = fr.count()
    base = _packed(assemble(fr.df, fr.num), n)
    models = []
    for c in classes:
        lr = MR.LinearRegression(featuresCol=FEAT, labelCol="_t", predictionCol="_s",
                                 regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False)
        models.append(lr.fit(base.withColumn("_t", F.when(fr.y() == c, 1.0).otherwise(-1.0))))

    def predict(df: DataFrame) -> DataFrame:
        a = assemble(df, fr.num)
        s = []
        for c, m in zip(classes, models):
            coef = m.coefficients.toArray()
            s.append(sum(float(coef[i]) * F.col(col).cast("double") for i, col in enumerate(fr.num)) + F.lit(m.intercept))
        a = a.withColumns({f"_s{i}": s[i] for i in range(len(classes))})
        return a.select(*df.columns, _argmax_label([f"_s{i}" for i in range(len(classes))], classes).alias("pred"))
    return FittedModel("ridge_classifier", predict, models, classes)


def _fit_adaboost(fr: Frame, n_estimators: int, seed: int) -> FittedModel:
    """SAMME with depth-1 trees: each round one weighted stump fit and one
    aggregate for the weighted error; weights live in a column."""
    classes = class_list(fr)
    k = len(classes)
    idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    data = assemble(fr.df, fr.num).withColumn(LBL, idx[fr.y()]).withColumn("_w", F.lit(1.0))
    n = fr.count()
    data = _packed(data.withColumn("_w", F.lit(1.0 / n)), n).cache()
    learners = []
    for r in range(n_estimators):
        stump = MC.DecisionTreeClassifier(maxDepth=1, featuresCol=FEAT, labelCol=LBL, weightCol="_w",
                                          predictionCol="_p", seed=seed + r).fit(data)
        pr = stump.transform(data).select(*data.columns, "_p")
        err = pr.agg((F.sum(F.when(F.col("_p") != F.col(LBL), F.col("_w"))) / F.sum("_w")).alias("e")).first()["e"] or 0.0
        if err >= 1.0 - 1.0 / k:
            break
        alpha = math.log((1.0 - err) / max(err, 1e-12)) + math.log(k - 1.0)
        learners.append((stump, alpha))
        if err <= 0:
            break
        nxt = pr.withColumn("_w", F.col("_w") * F.when(F.col("_p") != F.col(LBL), math.exp(alpha)).otherwise(1.0))
        tot = nxt.agg(F.sum("_w")).first()[0]
        data.unpersist()
        # cut the lineage each round (shared checkpoint folder)
        data = nxt.withColumn("_w", F.col("_w") / tot).drop("_p").checkpoint(eager=True)

    def predict(df: DataFrame) -> DataFrame:
        out = assemble(df, fr.num)
        votes = [F.lit(0.0)] * k
        for j, (m, a) in enumerate(learners):
            out = m.setPredictionCol(f"_p{j}").setRawPredictionCol(f"_r{j}").setProbabilityCol(f"_q{j}").transform(out)
            votes = [votes[c] + F.when(F.col(f"_p{j}") == float(c), a).otherwise(0.0) for c in range(k)]
        out = out.withColumns({f"_v{c}": votes[c] for c in range(k)})
        return out.select(*df.columns, _argmax_label([f"_v{c}" for c in range(k)], classes).alias("pred"))
    return FittedModel("ada_boost", predict, learners, classes)


# ------------------------------------------------------------------ regression
# Ridge's alpha = 1 is 1/n in terms of RSS / 2n + penalty; lasso's and elastic
# net's are the same.
def _penalised(l1: float, l2: float, spread: float):
    """Linear regression minimising RSS / 2n + l1 |w| + l2 |w|^2 / 2.  MLlib
    divides the quadratic penalty by the target's standard deviation
    (``spread``), which is undone here."""
    reg = l1 + l2 * spread
    return MR.LinearRegression(regParam=reg, elasticNetParam=l1 / reg, standardization=False)


REGRESSORS = {
    "lineal": lambda n, spread, seed: MR.LinearRegression(regParam=0.0),
    "ridge": lambda n, spread, seed: _penalised(0.0, 1.0 / n, spread),
    "lasso": lambda n, spread, seed: _penalised(1.0, 0.0, spread),
    "elasticnet": lambda n, spread, seed: _penalised(0.5, 0.5, spread),
    "arbol_decision": lambda n, spread, seed: MR.DecisionTreeRegressor(maxDepth=30, seed=seed),
    "random_forest": lambda n, spread, seed: MR.RandomForestRegressor(numTrees=100, maxDepth=30, seed=seed),
    "gradient_boosting": lambda n, spread, seed: MR.GBTRegressor(maxIter=100, maxDepth=3, seed=seed),
}


#: Weight column of cells.
CNT = "_n"
#: Rows of equal features that a cell stands for, on average, at least; otherwise trees are fitted on rows.
CELL_ROWS = 4
#: Rows of a task when trees are fitted on cells.
TASK_CELLS = 20_000
#: Trees whose bootstrap sums one aggregate makes; cells times trees of a forest on cells, at most.
BAG, MAX_BAG_CELLS = 10, 100_000_000
#: Tree learners to whose splits a cell's weight and mean target say the same as its rows.
ON_CELLS = {"arbol_decision", "gradient_boosting"}


def _mean(weight, target):
    """Weighted mean (null without weight); null as soon as one target is, which learners refuse."""
    return F.when(F.count(target) == F.count(F.lit(1)), F.try_divide(F.sum(weight * target), F.sum(weight)))


def cells(fr: Frame, target: str) -> tuple[DataFrame, int]:
    """Rows of equal features as one row with their number and mean target, written,
    and the number of such rows.  Variance inside a cell is on the same side of every
    split, so gains and leaf means of trees over cells are those over rows."""
    def make():
        t = F.col(target).cast("double")
        out = written(fr.df.groupBy(*fr.num).agg(F.count(F.lit(1)).cast("double").alias(CNT), _mean(F.lit(1.0), t).alias(target)), "cells")
        return out, out.count()
    return fr.memo(("cells", target), make)


def poisson_draw(row_id: str, seed: int, tree: int):
    """Times that a bootstrap of one tree has a row: Poisson of mean 1, drawn from the row's key."""
    u = f"shiftrightunsigned(xxhash64(`{row_id}`, {seed}, {tree}), 12)"
    p, upto, cases = math.exp(-1.0), 0.0, ""
    for j in range(18):
        upto += p
        cases += f" WHEN {u} < {int(upto * 2**52)} THEN {j}D"
        p /= j + 1
    return F.expr(f"CASE{cases} ELSE 18D END")  # one text: a call of the JVM a case takes seconds over 100 trees


def bootstrap_cells(fr: Frame, target: str, trees: int, seed: int) -> list[DataFrame]:
    """One table a tree: every row drawn as often as its key says for that tree,
    equal features as one row with the draws' number and mean target."""
    fr = keyed(fr)
    t = F.col(target).cast("double")
    out: list[DataFrame] = []
    for start in range(0, trees, BAG):
        block = range(start, min(start + BAG, trees))
        drawn = fr.df.select(*fr.num, t.alias(target), *[poisson_draw(fr.row_id, seed, i).alias(f"_w{i}") for i in block])
        sums = written(drawn.groupBy(*fr.num).agg(*[F.sum(f"_w{i}").alias(f"_w{i}") for i in block],
                                                  *[_mean(F.col(f"_w{i}"), F.col(target)).alias(f"_t{i}") for i in block]), "bags")
        out += [sums.where(F.col(f"_w{i}") > 0).select(*fr.num, F.col(f"_w{i}").alias(CNT), F.col(f"_t{i}").alias(target))
                for i in block]
    return out


def _fit_forest_on_cells(fr: Frame, target: str, est, seed: int, n_cells: int) -> FittedModel:
    """A forest whose trees see their bootstrap of the rows as cells, so that levels
    cost the distinct features, not the rows; prediction is the trees' mean."""
    trees = est.getNumTrees()
    subset = est.getFeatureSubsetStrategy()
    subset = ("onethird" if trees > 1 else "all") if subset == "auto" else subset
    bags = bootstrap_cells(fr, target, trees, seed)

    def one(i: int):
        tree = est.copy({est.numTrees: 1, est.bootstrap: False, est.featureSubsetStrategy: subset, est.seed: seed + i})
        data = bags[i].coalesce(max(1, n_cells // TASK_CELLS))
        return tree.setWeightCol(CNT).setPredictionCol(f"_p{i}").fit(assemble(data, fr.num))
    with ThreadPoolExecutor(8) as pool:
        models = list(pool.map(inheritable_thread_target(fr.spark)(one), range(trees)))

    def predict(df: DataFrame) -> DataFrame:
        seen = df.select(*[F.col(c).alias(f"_v{j}") for j, c in enumerate(fr.num)]).distinct()
        vec = VectorAssembler(inputCols=[f"_v{j}" for j in range(len(fr.num))], outputCol=FEAT, handleInvalid="keep").transform(seen)
        for m in models:
            vec = m.transform(vec)
        mean = sum((F.col(f"_p{i}") for i in range(1, trees)), F.col("_p0")) / float(trees)
        known = written(vec.select(*seen.columns, mean.alias("pred")), "forest")
        same = [F.col(c).eqNullSafe(F.col(f"_v{j}")) for j, c in enumerate(fr.num)]
        return df.join(known, same, "left").select(*df.columns, "pred")
    return FittedModel("random_forest", predict, models)


def fit_regressor(name: str, fr: Frame, target: str, seed: int = 42) -> FittedModel:
    if name not in REGRESSORS:
        raise ValueError(f"unknown regressor {name}")
    n, spread = fr.df.agg(F.count(F.lit(1)), F.stddev_pop(F.col(target).cast("double"))).first()
    est = REGRESSORS[name](max(n, 1), spread or 1.0, seed).setFeaturesCol(FEAT).setLabelCol(target).setPredictionCol("pred")
    data = fr.df
    if name in ON_CELLS or name == "random_forest":
        few, m = cells(fr, target)
        if m * CELL_ROWS <= n and name == "random_forest" and m * est.getNumTrees() <= MAX_BAG_CELLS:
            return _fit_forest_on_cells(fr, target, est, seed, m)
        if m * CELL_ROWS <= n and name in ON_CELLS:
            data, est = few.coalesce(max(1, m // TASK_CELLS)), est.setWeightCol(CNT)
    model = est.fit(assemble(data, fr.num))

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(assemble(df, fr.num)).select(*df.columns, "pred")
    return FittedModel(name, predict, model)


# ------------------------------------------------------------------ clustering
def fit_kmeans(fr: Frame, k: int = 8, seed: int = 42) -> FittedModel:
    model = MK.KMeans(k=k, seed=seed, featuresCol=FEAT, predictionCol="_c").fit(assemble(fr.df, fr.num))

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(assemble(df, fr.num)).select(*df.columns, F.col("_c").cast("string").alias("pred"))
    return FittedModel("kmeans", predict, model)


def spectral_clustering(fr: Frame, k: int = 8, n_neighbors: int = 10, seed: int = 42,
                        block_rows: int = 2048) -> DataFrame:
    """E18 (re-aimed): k-NN affinity graph from the pair kernel ->
    PowerIterationClustering.  Returns (row_id, pred)."""
    from .neighbourhood import knn_table
    f2 = Frame(df=fr.df, num=fr.num, cat=(), label=fr.label, row_id=fr.row_id)
    edges = knn_table(f2, n_neighbors=n_neighbors, block_rows=block_rows)
    # one row a pair: the clustering mirrors every row itself
    aff = edges.groupBy(F.least("row_id", "nb_id").alias("src"), F.greatest("row_id", "nb_id").alias("dst")).agg(
        F.exp(-F.max("nb_dist") * F.max("nb_dist")).alias("weight"))
    pic = MK.PowerIterationClustering(k=k, maxIter=20, weightCol="weight", initMode="degree")
    return pic.assignClusters(aff).select(F.col("id").alias("row_id"), F.col("cluster").cast("string").alias("pred"))


def dbscan(fr: Frame, eps: float = 0.5, min_samples: int = 5, block_rows: int = 2048) -> DataFrame:
    """Density clusters (Euclidean).  Core rows have >= min_samples rows
    (themselves included) within eps.  Clusters are the connected components
    of core rows linked within eps; border rows take the smallest cluster
    label among their core neighbours; the rest is noise (-1).  Two passes
    over the cells within eps of a row and one contraction of their links
    (``cells.density_clusters``).  Returns (row_id, pred) with clusters
    numbered from 0 in order of their smallest core row."""
    from ..functions.ranking import sorted_levels
    from .cells import density_clusters
    from .pairs import scaled_matrix
    final = density_clusters(scaled_matrix(fr, None), eps, min_samples, "euclidean", block_rows)
    ids = final.where(F.col("root").isNotNull()).select(F.col("root").alias("value")).distinct()
    out = final.join(sorted_levels(ids).withColumnRenamed("value", "root"), "root", "left")
    return out.select("row_id", F.coalesce(F.col("code"), F.lit(-1)).cast("string").alias("pred"))
