"""Classifiers are fitted on as many partitions as the rows fill."""

from pyspark.ml import classification as MC
from pyspark.sql import functions as F

from metaprism.frame import Frame
from metaprism.operators import models as E


def test_small_tables_are_fitted_in_one_task(spark, monkeypatch):
    rows = spark.range(300, numPartitions=6).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("y"))
    fr = Frame(df=rows, num=("a",), label="y", row_id="row_id")
    parts, fit = [], MC.DecisionTreeClassifier._fit
    monkeypatch.setattr(MC.DecisionTreeClassifier, "_fit",
                        lambda est, df: parts.append((df.rdd.getNumPartitions(), df.count())) or fit(est, df))
    E.fit_classifier("decision_tree", fr)
    monkeypatch.setattr(E, "FIT_ROWS", 100)
    E.fit_classifier("decision_tree", fr)
    assert parts == [(1, 300), (3, 300)]
