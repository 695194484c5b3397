"""Model-based features of a tree fitted elsewhere."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from metaprism.operators import modelbased as MB
from metaprism.plans.extract import extract, extract_from_model
from metaprism.sources.tables import embeddings_frame

from paths import SF0001


def _values(df):
    return {r["name"]: r["value"] for r in df.collect()}


def test_as_by_extraction(spark):
    fr = embeddings_frame(spark, SF0001)
    model, classes = MB.fit_tree(fr)
    got = _values(extract_from_model(model, spark, attrs=fr.num, classes=classes))
    want = _values(extract(fr, "model-based"))
    assert got.keys() == want.keys() and len(got) > 14
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True), k
    only = _values(extract_from_model(model, spark, ["leaves", "tree_depth"], summary=("max",)))
    assert only == {"leaves": got["leaves"], "tree_depth.max": model.depth}


def test_a_pipeline_and_a_tree_of_one_leaf(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, y double")
    steps = [VectorAssembler(inputCols=["x"], outputCol="v"), DecisionTreeClassifier(featuresCol="v", labelCol="y", maxDepth=2)]
    got = _values(extract_from_model(Pipeline(stages=steps).fit(df), spark, ["nodes_per_inst", "nodes", "leaves"]))
    assert got["leaves"] == got["nodes"] + 1 and got["nodes_per_inst"] == got["nodes"] / 20
    alone = Pipeline(stages=steps).fit(df.withColumn("y", F.lit(1.0)))
    assert _values(extract_from_model(alone, spark, ["leaves", "nodes"])) == {"leaves": 1.0, "nodes": 0.0}


def test_other_models_are_refused(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, y double")
    v = VectorAssembler(inputCols=["x"], outputCol="v").transform(df)
    with pytest.raises(TypeError):
        extract_from_model(LogisticRegression(featuresCol="v", labelCol="y", maxIter=1).fit(v), spark)
    with pytest.raises(TypeError):
        extract_from_model(DecisionTreeClassifier(), spark)
    tree = DecisionTreeClassifier(featuresCol="v", labelCol="y").fit(v)
    with pytest.raises(ValueError):
        extract_from_model(tree, spark, attrs=["a", "b"])


def test_depths_of_a_deep_tree_hold_no_rounds(spark):
    """Depths as the tree has them, in a plan that does not grow by a join a level."""
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(64)], "x double, y double")
    v = VectorAssembler(inputCols=["x"], outputCol="v").transform(df)
    tree = DecisionTreeClassifier(featuresCol="v", labelCol="y", maxDepth=30, maxBins=64).fit(v)
    nodes = MB.node_table(tree, spark)
    kids, want, level = {r["id"]: (r["left"], r["right"]) for r in nodes.collect()}, {0: 0}, [0]
    while level:
        level = [(k, want[i] + 1) for i in level if kids[i][0] >= 0 for k in kids[i]]
        want |= dict(level)
        level = [k for k, _ in level]
    assert {r["id"]: r["depth"] for r in nodes.collect()} == want and len(want) == tree.numNodes
    assert max(want.values()) == tree.depth > 5
    assert "Join" not in nodes._jdf.queryExecution().optimizedPlan().toString()
