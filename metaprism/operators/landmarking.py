"""Landmarking (L1-L7): k-fold scores of simple learners.

Folds follow the unshuffled stratified rule (``splits.kfold_stratified`` with
shuffle=False) by default.  1-NN landmarks use ONE pair-kernel pass in which
each row only sees rows of other folds, which is exactly every fold's
train/test split at once.  Tree / discriminant / naive-Bayes landmarks fit
Spark ML models per fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, keyed
from ..session import written
from . import splits
from .cells import CELL_ROWS, Enemies
from .neighbourhood import PAIR_ROWS
from .pairs import pair_stats, sorted_classes

#: Rows of all trees that are fitted at a time, unless one alone has more.
TREE_ROWS = 200_000


def cv_folds(fr: Frame, k: int = 10, shuffle: bool = False, seed: int = 42) -> DataFrame:
    return splits.kfold_stratified(fr, k=k, shuffle=shuffle, seed=seed)


def _folded(fr: Frame, k: int) -> DataFrame:
    """The rows with their folds and label ``y``, written once a Frame: every
    landmarker reads the same ones."""
    return fr.memo(("folds", k), lambda: written(cv_folds(fr, k).withColumn("y", fr.y()), "folds").cache())


def _score(df: DataFrame, score: str) -> DataFrame:
    """(fold, value) per fold for the chosen score of (y, pred)."""
    hit = (F.col("y") == F.col("pred")).cast("double")
    if score == "accuracy":
        return df.groupBy("fold").agg(F.avg(hit).alias("value"))
    if score == "balanced-accuracy":
        per = df.groupBy("fold", "y").agg(F.avg(hit).alias("r"))
        return per.groupBy("fold").agg(F.avg("r").alias("value"))
    raise ValueError(f"unknown score {score}")


def _other_folds_nearest(fr: Frame, mat: DataFrame, block_rows: int) -> DataFrame:
    """(row_id, y, fold, pred): label of the nearest row of another fold of
    every row of ``mat`` (row_id, y, x, grp); many rows search over cells."""
    if fr.count() <= PAIR_ROWS:
        st = pair_stats(mat, sorted_classes(fr), "euclidean", block_rows, n=fr.count(), want=("nn",))
        return st.select("row_id", "y", F.col("nn_y").alias("pred")).join(mat.select("row_id", F.col("grp").alias("fold")), "row_id")
    found = Enemies(mat, "euclidean", min(CELL_ROWS, block_rows)).nearest(mat.select("row_id", F.col("grp").alias("g")))
    label = mat.select(F.col("row_id").alias("ne_id"), F.col("y").alias("pred"))
    near = found.select("row_id", "ne_id").join(label, "ne_id").select("row_id", "pred")
    return mat.select("row_id", "y", F.col("grp").alias("fold")).join(near, "row_id", "left")


def ft_one_nn(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10, cols=None,
              block_rows: int = 2048, feature: str = "one_nn") -> DataFrame:
    cols = list(cols or fr.num)
    fr = keyed(fr, integral=True)
    folded = _folded(fr, num_cv_folds)
    mat = folded.select(F.col(fr.row_id).cast("long").alias("row_id"), fr.y().alias("y"),
                        F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                        F.col("fold").alias("grp")).cache()
    pred = _other_folds_nearest(fr, mat, block_rows)
    sc = _score(pred, score)
    return sc.select(entry(feature, F.col("value"), idx=F.col("fold")).alias("e")).select("e.*")


# ----------------------------------------------------- model landmarks
def _fold_scores(fr: Frame, feature: str, fit_predict, score: str, num_cv_folds: int) -> DataFrame:
    """Fit on each fold's train part, predict its test part; one score per
    fold.  ``fit_predict(train: Frame, fold: int) -> predict(df) -> df+pred``."""
    fr = keyed(fr)
    folded = _folded(fr, num_cv_folds)

    def one(f):
        train = Frame(df=folded.where(F.col("fold") != f), num=fr.num, cat=(), label="y", row_id=fr.row_id)
        predict = fit_predict(train, f)
        return predict(folded.where(F.col("fold") == f)).select("fold", "y", "pred")
    # folds are independent fits: submit them concurrently (each is its own
    # distributed job; the driver only waits)
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(8, num_cv_folds)) as pool:
        preds = list(pool.map(one, range(num_cv_folds)))
    from ..frame import union_all
    sc = _score(union_all(preds), score)
    return sc.select(entry(feature, F.col("value"), idx=F.col("fold")).alias("e")).select("e.*")


def _tree_importances(train: Frame, seed: int):
    from .models import fit_classifier
    m = fit_classifier("decision_tree", train, seed=seed)
    return m.model.featureImportances.toArray()


def _fold_importances(fr: Frame, folded: DataFrame, k: int, seed: int) -> list:
    """The column importances of each fold's tree, fitted once a Frame: worst
    and elite landmarkers choose by the same trees."""
    def fit() -> list:
        def one(f):
            return _tree_importances(Frame(df=folded.where(F.col("fold") != f), num=fr.num, cat=(), label="y", row_id=fr.row_id), seed)
        from concurrent.futures import ThreadPoolExecutor
        # a tree grows with the rows and is whole on the driver while it is fitted
        with ThreadPoolExecutor(max_workers=max(1, min(8, k, TREE_ROWS // max(1, fr.count())))) as pool:
            return list(pool.map(one, range(k)))
    return fr.memo(("fold importances", k, seed), fit)


def _stump(cols):
    def fit_predict(train: Frame, f: int):
        from .models import fit_classifier
        sub = Frame(df=train.df, num=tuple(cols(train, f)), cat=(), label=train.label, row_id=train.row_id)
        return fit_classifier("decision_tree", sub, maxDepth=1).predict
    return fit_predict


def ft_best_node(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10) -> DataFrame:
    return _fold_scores(fr, "best_node", _stump(lambda t, f: t.num), score, num_cv_folds)


def ft_random_node(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10, random_state: int = 0) -> DataFrame:
    import random
    col = random.Random(random_state).choice(list(fr.num))
    return _fold_scores(fr, "random_node", _stump(lambda t, f: [col]), score, num_cv_folds)


def ft_worst_node(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10, seed: int = 0) -> DataFrame:
    fr = keyed(fr)
    importances = _fold_importances(fr, _folded(fr, num_cv_folds), num_cv_folds, seed)

    def worst(t: Frame, f: int):
        return [t.num[int(importances[f].argmin())]]
    return _fold_scores(fr, "worst_node", _stump(worst), score, num_cv_folds)


def ft_linear_discr(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10) -> DataFrame:
    from .models import fit_classifier
    return _fold_scores(fr, "linear_discr",
                        lambda t, f: fit_classifier("linear_discriminant_analysis", t).predict, score, num_cv_folds)


def ft_naive_bayes(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10) -> DataFrame:
    from .models import fit_classifier
    return _fold_scores(fr, "naive_bayes", lambda t, f: fit_classifier("gaussian_nb", t).predict, score, num_cv_folds)


def ft_elite_nn(fr: Frame, score: str = "accuracy", num_cv_folds: int = 10, seed: int = 0,
                block_rows: int = 2048) -> DataFrame:
    """1-NN on the most important column of each fold's tree; the folds that
    chose a column share one kernel pass."""
    fr = keyed(fr, integral=True)
    folded = _folded(fr, num_cv_folds)
    importances = _fold_importances(fr, folded, num_cv_folds, seed)
    chosen = [fr.num[int(importances[f].argmax())] for f in range(num_cv_folds)]
    preds = []
    for col in sorted(set(chosen)):
        mat = folded.select(F.col(fr.row_id).cast("long").alias("row_id"), "y", F.array(F.col(col).cast("double")).alias("x"), F.col("fold").alias("grp"))
        p = _other_folds_nearest(fr, mat, block_rows)
        preds.append(p.where(F.col("fold").isin([f for f, c in enumerate(chosen) if c == col])).select("fold", "y", "pred"))
    from ..frame import union_all
    sc = _score(union_all(preds), score)
    return sc.select(entry("elite_nn", F.col("value"), idx=F.col("fold")).alias("e")).select("e.*")


FEATURES = {"best_node": ft_best_node, "elite_nn": ft_elite_nn, "linear_discr": ft_linear_discr,
            "naive_bayes": ft_naive_bayes, "one_nn": ft_one_nn, "random_node": ft_random_node,
            "worst_node": ft_worst_node}
