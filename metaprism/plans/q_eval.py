"""Registered queries: splits (R), evaluation (V), landmarking 1-NN."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.numeric import sig, sql_sig
from ..operators import evaluation as V
from ..operators import landmarking as L
from ..operators import neighbourhood as NB
from ..operators import splits as R
from ..session import read_table
from ..sources.tables import embeddings_frame, lineitem_frame
from .extract import extract_with_confidence
from .registry import query, finish_long, sql_long, row
from .sqlbind import EM_CTE, with_
from .q_pairs import P_CTE


def orders_frame(spark, sf_dir) -> Frame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("y"))
    return Frame(df=o, num=("o_totalprice",), cat=(), label="y", row_id="o_orderkey", name="orders")


_HK = R.sql_hkey("o_orderkey", 42)


@query("kfold_stratified",
       f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HK}, o_orderkey) - 1) % 3 "
       "AS INTEGER) AS fold FROM orders", group="splits")
def q_kfold_stratified(spark, sf_dir):
    return R.kfold_stratified(orders_frame(spark, sf_dir), k=3).select("o_orderkey", "fold")


_UNSHUF = (
    "WITH o AS (SELECT o_orderkey, o_orderpriority AS y FROM orders), "
    "cls AS (SELECT y, count(*) AS m, sum(count(*)) OVER (ORDER BY y) - count(*) AS s FROM o GROUP BY y), "
    "al AS (SELECT y, i, floor((s + m - 1 - i) / 10.0) - floor((s - 1 - i) / 10.0) AS a FROM cls, range(10) AS t(i)), "
    "cum AS (SELECT y, i, sum(a) OVER (PARTITION BY y ORDER BY i) AS c FROM al), "
    "r AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY o_orderkey) - 1 AS rk FROM o) "
    "SELECT o_orderkey, CAST((SELECT count(*) FROM cum WHERE cum.y = r.y AND cum.i < 9 AND cum.c <= r.rk) AS INTEGER) "
    "AS fold FROM r")


@query("kfold_stratified_unshuffled", _UNSHUF, group="splits")
def q_kfold_unshuffled(spark, sf_dir):
    return R.kfold_stratified(orders_frame(spark, sf_dir), k=10, shuffle=False).select("o_orderkey", "fold")


@query("kfold_plain",
       f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_HK}, o_orderkey) - 1) % 3 AS INTEGER) AS fold FROM orders",
       group="splits")
def q_kfold_plain(spark, sf_dir):
    return R.kfold_plain(orders_frame(spark, sf_dir), k=3).select("o_orderkey", "fold")


@query("sample_rows",
       f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_HK}, o_orderkey) - 1 AS rk FROM orders) AS t "
       "WHERE rk < CAST(floor((SELECT count(*) FROM orders) * 0.7) AS BIGINT)", group="splits")
def q_sample_rows(spark, sf_dir):
    return R.sample_rows(orders_frame(spark, sf_dir), 0.7).select("o_orderkey")


@query("interpolate_rows", group="splits")
def q_interpolate(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    return R.interpolate_rows(fr)


@query("bootstrap_weights", group="splits")
def q_bootstrap(spark, sf_dir):
    """Poisson(1) bootstrap weights, then the weighted mean per replicate of
    o_totalprice (all replicates in one aggregate)."""
    fr = orders_frame(spark, sf_dir)
    j = R.bootstrap_weights(fr, keep=[F.col("o_totalprice")])
    return j.groupBy("rep").agg((F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w")).alias("mean"))


# ------------------------------------------------------------- evaluation
_VOTE = ("pv AS (SELECT i, first(yj ORDER BY v DESC, yj) AS pred FROM (SELECT i, yj, count(*) AS v FROM ("
         "SELECT i, yj, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p) AS t WHERE rk <= 5 "
         "GROUP BY i, yj) AS u GROUP BY i)")
_CLS_METRICS = with_(EM_CTE, P_CTE, _VOTE,
                     "yp AS (SELECT em.y, pv.pred FROM em JOIN pv ON pv.i = em.row_id)",
                     "lb AS (SELECT y AS l FROM yp UNION SELECT pred FROM yp)",
                     "per AS (SELECT l, (SELECT count(*) FROM yp WHERE y = l) AS sup, "
                     "(SELECT count(*) FROM yp WHERE pred = l) AS prd, "
                     "(SELECT count(*) FROM yp WHERE y = l AND pred = l) AS tp FROM lb)",
                     "pr AS (SELECT *, CASE WHEN prd > 0 THEN tp * 1.0 / prd ELSE 0.0 END AS p, "
                     "CASE WHEN sup > 0 THEN tp * 1.0 / sup ELSE 0.0 END AS r FROM per)") + (
    f"SELECT {sql_sig('sum(tp) * 1.0 / (SELECT count(*) FROM yp)')} AS accuracy, "
    f"{sql_sig('avg(CASE WHEN sup > 0 THEN r END)')} AS balanced_accuracy, "
    f"{sql_sig('sum(sup * p) / (SELECT count(*) FROM yp)')} AS precision, "
    f"{sql_sig('sum(sup * r) / (SELECT count(*) FROM yp)')} AS recall, "
    f"{sql_sig('sum(sup * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) / (SELECT count(*) FROM yp)')} AS f1 "
    "FROM pr")


@query("classification_metrics", _CLS_METRICS, group="evaluation")
def q_cls_metrics(spark, sf_dir):
    fr = embeddings_frame(spark, sf_dir)
    pred = NB.knn_vote(fr, k=5).join(fr.df.select("row_id", "y"), "row_id")
    m = V.classification_metrics(pred)
    return m.select(*[sig(F.col(c)).alias(c) for c in m.columns])


_REG = ("WITH pr AS (SELECT o.o_totalprice AS y, l.s AS pred FROM orders AS o JOIN (SELECT l_orderkey, "
        "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY l_orderkey) AS l "
        "ON l.l_orderkey = o.o_orderkey) "
        f"SELECT {sql_sig('avg(abs(y - pred))')} AS mae, {sql_sig('avg((y - pred) * (y - pred))')} AS mse, "
        f"{sql_sig('sqrt(avg((y - pred) * (y - pred)))')} AS rmse, "
        f"{sql_sig('CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)) ELSE -1 END')} AS r2, "
        f"{sql_sig('quantile_cont(abs(y - pred), 0.5)')} AS medae, "
        f"{sql_sig('CASE WHEN var_pop(y) > 0 THEN 1 - var_pop(y - pred) / var_pop(y) ELSE -1 END')} AS ev FROM pr")


@query("regression_metrics", _REG, group="evaluation")
def q_reg_metrics(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    pred = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    j = o.join(pred, o.o_orderkey == pred.l_orderkey)
    m = V.regression_metrics(j)
    return m.select(*[sig(F.col(c)).alias(c) for c in m.columns])


# ----------------------------------------------------------- landmarking
_FOLDS_EM = (
    "cls AS (SELECT y, count(*) AS m, sum(count(*)) OVER (ORDER BY y) - count(*) AS s FROM em GROUP BY y), "
    "al AS (SELECT y, i, floor((s + m - 1 - i) / 10.0) - floor((s - 1 - i) / 10.0) AS a FROM cls, range(10) AS t(i)), "
    "cum AS (SELECT y, i, sum(a) OVER (PARTITION BY y ORDER BY i) AS c FROM al), "
    "rk AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS rk FROM em), "
    "fd AS (SELECT row_id, y, (SELECT count(*) FROM cum WHERE cum.y = rk.y AND cum.i < 9 AND cum.c <= rk.rk) AS fold FROM rk)")
_NN_CV = ("nn AS (SELECT p.i, first(p.yj ORDER BY p.d, p.j) AS pred FROM p JOIN fd AS a ON a.row_id = p.i "
          "JOIN fd AS b ON b.row_id = p.j WHERE a.fold <> b.fold GROUP BY p.i)")
_ONE_NN = with_(EM_CTE, P_CTE, _FOLDS_EM, _NN_CV) + sql_long(
    row("one_nn", "avg(CAST(fd.y = nn.pred AS DOUBLE))", idx="fold", src="FROM fd JOIN nn ON nn.i = fd.row_id GROUP BY fold"))


@query("landmark_one_nn", _ONE_NN, group="landmarking")
def q_one_nn(spark, sf_dir):
    return finish_long(L.ft_one_nn(embeddings_frame(spark, sf_dir)))


_AVG_FOLDS = with_(EM_CTE, P_CTE, _FOLDS_EM, _NN_CV) + (
    ", acc AS (SELECT fold, avg(CAST(fd.y = nn.pred AS DOUBLE)) AS v FROM fd JOIN nn ON nn.i = fd.row_id GROUP BY fold) "
    f"SELECT 'one_nn' AS model, 'accuracy' AS metric, {sql_sig('avg(CASE WHEN fold = 3 THEN NULL ELSE v END)')} AS value_ok, "
    f"{sql_sig('avg(CASE WHEN fold = 3 THEN -1.0 ELSE v END)')} AS value, 'CRASH' AS status FROM acc")


@query("average_folds", _AVG_FOLDS, group="evaluation")
def q_average_folds(spark, sf_dir):
    """Fold scores of the 1-NN landmark, with fold 3 marked failed (null):
    the failed fold counts with the penalty and the model gets CRASH."""
    scores = L.ft_one_nn(embeddings_frame(spark, sf_dir))
    m = scores.select(F.lit("one_nn").alias("model"), F.lit("accuracy").alias("metric"),
                      F.when(F.col("idx") == 3, F.lit(None)).otherwise(F.col("value")).alias("value"))
    ok = m.where(F.col("value").isNotNull()).groupBy("model", "metric").agg(F.avg("value").alias("value_ok"))
    out = V.average_folds(m, "clasificacion").join(ok, ["model", "metric"])
    return out.select("model", "metric", sig(F.col("value_ok")).alias("value_ok"), sig(F.col("value")).alias("value"),
                      "status")


@query("bootstrap_ci", group="splits")
def q_bootstrap_ci(spark, sf_dir):
    """Basic 95 % interval of the column means of LI from 128 Poisson
    bootstrap replicates (one weighted aggregate)."""
    from ..sources.tables import lineitem_frame
    fr = lineitem_frame(spark, sf_dir, with_cat=False)
    li = fr.df.withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    fr2 = Frame(df=li, num=fr.num, cat=(), label="y", row_id="row_id")
    return R.bootstrap_ci(fr2, "mean", replicates=128, confidence=(0.9, 0.95))


@query("extract_with_confidence", group="splits")
def q_extract_with_confidence(spark, sf_dir):
    """Intervals of all features that moments determine, on LI."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # it names the features without intervals
        return extract_with_confidence(lineitem_frame(spark, sf_dir), ("general", "statistical"), confidence=(0.9, 0.95))


_MATCH_SQL = """
WITH ct AS (SELECT l_linestatus AS c, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
grid AS (SELECT cs.c, ys.y, coalesce(ct.n, 0) AS n FROM (SELECT DISTINCT c FROM ct) AS cs
  CROSS JOIN (SELECT DISTINCT y FROM ct) AS ys LEFT JOIN ct ON ct.c = cs.c AND ct.y = ys.y),
best AS (SELECT a.c AS c1, a.y AS y1, b.c AS c2, b.y AS y2 FROM grid AS a JOIN grid AS b ON a.c < b.c AND a.y <> b.y
  ORDER BY a.n + b.n DESC LIMIT 1)
SELECT c1 AS cluster, y1 AS mapped FROM best UNION ALL SELECT c2, y2 FROM best
"""


@query("cluster_class_match", _MATCH_SQL, group="evaluation")
def q_cluster_class_match(spark, sf_dir):
    """V6 with l_linestatus as clusters and l_returnflag as classes; the SQL
    tries every one-to-one assignment of the two clusters."""
    from ..session import read_table
    return V.cluster_class_match(read_table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag")
