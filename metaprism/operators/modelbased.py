"""Model-based meta-features (M1-M14, MX1): shape of a fitted decision tree.

The tree is a Spark ML ``DecisionTreeClassificationModel``.  Its node table
is read the way any Spark user can: save the model to the shared checkpoint
folder and read ``<path>/data`` as parquet (columns id, prediction, impurity,
impurityStats, rawCount, gain, leftChild, rightChild, split).  Node depths
come from joins with ever higher ancestors (pointer doubling: five rounds for
the 30 levels of the deepest tree), each round written to the shared folder, so
that no plan holds more than one of them.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, unpivot
from ..session import ensure_checkpoint_dir, written
from . import moments as M
from .models import FEAT, LBL, _indexed, class_list


def fit_tree(fr: Frame, max_depth: int = 30, seed: int = 42):
    classes = class_list(fr)
    model = DecisionTreeClassifier(featuresCol=FEAT, labelCol=LBL, maxDepth=max_depth, seed=seed,
                                   maxBins=256, cacheNodeIds=True).fit(_indexed(fr, classes))
    return model, classes


def node_table(model, spark=None) -> DataFrame:
    """MX1: (id, prediction, rawCount, left, right, feature, is_leaf, depth)."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/dt-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "rawCount", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"))
    nodes = nodes.withColumn("is_leaf", F.col("left") < 0)
    up = nodes.where(~F.col("is_leaf")).select(F.explode(F.array("left", "right")).alias("id"), F.col("id").alias("up"))
    # (id, up, depth): the ancestor ``depth`` levels above, none for the root
    at = written(nodes.select("id").join(up, "id", "left").select("id", "up", F.col("up").isNotNull().cast("int").alias("depth")), "dt-up")
    while not at.where("up is not null").isEmpty():  # every round doubles the step
        above = at.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        at = written(at.join(above, "up", "left").select(
            "id", F.col("top").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "dt-up")
    return written(nodes.join(at.select("id", "depth"), "id"), "dt-nodes")


class TreeContext:
    """A fitted tree with its nodes, column and class names and number of rows."""

    def __init__(self, fr: Frame, max_depth: int = 30, seed: int = 42):
        self.model, self.classes = fit_tree(fr, max_depth, seed)
        self.spark, self.attrs, self.n = fr.spark, list(fr.num), fr.count()
        self.nodes = node_table(self.model, fr.spark)

    @classmethod
    def of(cls, model, spark, attrs=None, classes=None) -> "TreeContext":
        """Of a model fitted elsewhere: a decision tree classifier, or a fitted
        pipeline that ends with one.  Names default to the numbers of features
        and classes; the rows are those that the tree counted at its root."""
        tree = model.stages[-1] if isinstance(model, PipelineModel) and model.stages else model
        if not isinstance(tree, DecisionTreeClassificationModel):
            raise TypeError(f"a fitted decision tree classifier is needed, not {type(tree).__name__}")
        t = cls.__new__(cls)
        t.model, t.spark = tree, spark
        t.attrs = [str(i) for i in range(tree.numFeatures)] if attrs is None else list(attrs)
        t.classes = [str(i) for i in range(tree.numClasses)] if classes is None else list(classes)
        if len(t.attrs) != tree.numFeatures or len(t.classes) != tree.numClasses:
            raise ValueError(f"the tree has {tree.numFeatures} features and {tree.numClasses} classes")
        t.nodes = node_table(tree, spark)
        t.n = t.nodes.where(F.col("depth") == 0).first()["rawCount"]
        return t


def _leaves(t: TreeContext) -> DataFrame:
    return t.nodes.where("is_leaf")


def _inner(t: TreeContext) -> DataFrame:
    return t.nodes.where("NOT is_leaf")


def ft_leaves(t):
    return unpivot(_leaves(t).agg(F.count(F.lit(1)).alias("v")), [entry("leaves", F.col("v"))])


def ft_nodes(t):
    return unpivot(_inner(t).agg(F.count(F.lit(1)).alias("v")), [entry("nodes", F.col("v"))])


def ft_nodes_per_attr(t):
    return unpivot(_inner(t).agg(F.count(F.lit(1)).alias("v")), [entry("nodes_per_attr", F.col("v") / len(t.attrs))])


def ft_nodes_per_inst(t):
    return unpivot(_inner(t).agg(F.count(F.lit(1)).alias("v")), [entry("nodes_per_inst", F.col("v") / float(t.n))])


def ft_tree_depth(t):
    return t.nodes.select(entry("tree_depth", F.col("depth"), idx=F.col("id")).alias("e")).select("e.*")


def ft_leaves_branch(t):
    return _leaves(t).select(entry("leaves_branch", F.col("depth"), idx=F.col("id")).alias("e")).select("e.*")


def ft_leaves_corrob(t):
    root = t.nodes.where(F.col("depth") == 0).first()["rawCount"]
    return _leaves(t).select(entry("leaves_corrob", F.col("rawCount") / float(root), idx=F.col("id")).alias("e")).select("e.*")


def _p(depth):
    return F.pow(F.lit(2.0), -depth.cast("double"))


def ft_tree_shape(t):
    p = _p(F.col("depth"))
    return _leaves(t).select(entry("tree_shape", -p * F.log2(p), idx=F.col("id")).alias("e")).select("e.*")


def ft_leaves_homo(t):
    k = _leaves(t).count()
    p = _p(F.col("depth"))
    return _leaves(t).select(entry("leaves_homo", F.lit(float(k)) / (-p * F.log2(p)), idx=F.col("id")).alias("e")).select("e.*")


def ft_leaves_per_class(t):
    k = _leaves(t).count()
    names = F.array(*[F.lit(c) for c in t.classes])
    per = _leaves(t).groupBy("prediction").agg(F.count(F.lit(1)).alias("c"))
    return per.select(entry("leaves_per_class", F.col("c") / float(k),
                            cls=names[F.col("prediction").cast("int")]).alias("e")).select("e.*")


def ft_nodes_per_level(t):
    per = _inner(t).groupBy("depth").agg(F.count(F.lit(1)).alias("c"))
    return per.select(entry("nodes_per_level", F.col("c"), idx=F.col("depth")).alias("e")).select("e.*")


def ft_nodes_repeated(t):
    names = F.array(*[F.lit(c) for c in t.attrs])
    per = _inner(t).groupBy("feature").agg(F.count(F.lit(1)).alias("c"))
    return per.select(entry("nodes_repeated", F.col("c"), attr=names[F.col("feature")], idx=F.col("feature")).alias("e")).select("e.*")


def ft_var_importance(t):
    imp = t.model.featureImportances.toArray()
    return M.values_frame(t.spark, "var_importance", imp, attrs=t.attrs)


def ft_tree_imbalance(t):
    p = _p(F.col("depth"))
    per = _leaves(t).groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    a = F.pow(F.lit(2.0), -(F.col("p") * F.col("c")))
    return per.select(entry("tree_imbalance", -a * F.log2(a)).alias("e")).select("e.*")


FEATURES = {
    "leaves": ft_leaves, "leaves_branch": ft_leaves_branch, "leaves_corrob": ft_leaves_corrob,
    "leaves_homo": ft_leaves_homo, "leaves_per_class": ft_leaves_per_class, "nodes": ft_nodes,
    "nodes_per_attr": ft_nodes_per_attr, "nodes_per_inst": ft_nodes_per_inst,
    "nodes_per_level": ft_nodes_per_level, "nodes_repeated": ft_nodes_repeated,
    "tree_depth": ft_tree_depth, "tree_imbalance": ft_tree_imbalance, "tree_shape": ft_tree_shape,
    "var_importance": ft_var_importance,
}
