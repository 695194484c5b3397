"""Registered queries: pair-kernel features on the embeddings table (EM).

EM: 500 rows at sf0.001/sf0.01 (2000 at sf0.1), four embedding elements as
columns, label = class.  The SQL twins enumerate all ordered pairs with a
self-join - fine for the oracle, which is not the engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import union_all
from ..functions.numeric import sig, sql_sig
from ..operators import neighbourhood as NB
from ..sources.tables import embeddings_frame
from .registry import query, finish_long, sql_long, row, union
from .sqlbind import EM_CTE, EM_NUM, with_

D = len(EM_NUM)
CELL = 100  # rows a cell, so that these tables have several
ONE = "FROM (SELECT 1) AS one"


def _em(spark, sf_dir):
    return embeddings_frame(spark, sf_dir)


def _euclid(a="a", b="b"):
    return "sqrt(" + " + ".join(f"power({a}.{c} - {b}.{c}, 2)" for c in EM_NUM) + ")"


def _gower(a="a", b="b"):
    return "((" + " + ".join(f"abs({a}.{c} - {b}.{c})" for c in EM_NUM) + f") / {float(D)})"


EMM_CTE = ("emm AS (SELECT row_id, y, " + ", ".join(
    f"({c} - (SELECT min({c}) FROM em)) / (CASE WHEN (SELECT max({c}) - min({c}) FROM em) = 0 THEN 1.0 "
    f"ELSE (SELECT max({c}) - min({c}) FROM em) END) AS {c}" for c in EM_NUM) + " FROM em)")
P_CTE = f"p AS (SELECT a.row_id AS i, b.row_id AS j, a.y AS yi, b.y AS yj, {_euclid()} AS d FROM em AS a JOIN em AS b ON a.row_id <> b.row_id)"
G_CTE = f"g AS (SELECT a.row_id AS i, b.row_id AS j, a.y AS yi, b.y AS yj, {_gower()} AS d FROM emm AS a JOIN emm AS b ON a.row_id <> b.row_id)"
C_CTE = f"c AS (SELECT a.row_id AS i, b.row_id AS j, a.y AS yi, b.y AS yj, {_euclid()} AS d FROM emm AS a JOIN emm AS b ON a.row_id <> b.row_id)"
CNT_CTE = "cnt AS (SELECT y, count(*) AS n FROM em GROUP BY y)"

# ------------------------------------------------------------- clustering
_VDU = ("(SELECT min(md / (ca.n * cb.n)) FROM (SELECT yi, yj, min(d) AS md FROM p WHERE yi < yj GROUP BY 1, 2) AS t "
        "JOIN cnt AS ca ON ca.y = t.yi JOIN cnt AS cb ON cb.y = t.yj) / (SELECT max(d) FROM p WHERE yi = yj)")
_INT = ("(SELECT sum(sd / (ca.n * cb.n)) * 2.0 / ((SELECT count(*) FROM cnt) * ((SELECT count(*) FROM cnt) - 1.0)) "
        "FROM (SELECT yi, yj, sum(d) AS sd FROM p WHERE yi < yj GROUP BY 1, 2) AS t "
        "JOIN cnt AS ca ON ca.y = t.yi JOIN cnt AS cb ON cb.y = t.yj)")
_SIL = ("(SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) FROM ("
        "SELECT i, max(CASE WHEN yi = yj THEN m END) AS a, min(CASE WHEN yi <> yj THEN m END) AS b FROM ("
        "SELECT i, yi, yj, avg(d) AS m FROM p GROUP BY 1, 2, 3) AS t GROUP BY i) AS u)")
_PB = "(SELECT corr(CAST(yi = yj AS DOUBLE), d) FROM p WHERE i < j)"

_CLUST_SQL = with_(EM_CTE, P_CTE, CNT_CTE) + sql_long(union([
    row("vdu", _VDU, idx=0, src=ONE), row("int", _INT, idx=0, src=ONE),
    row("sil", _SIL, src=ONE), row("pb", _PB, src=ONE)]))


@query("clustering_distances", _CLUST_SQL, group="clustering")
def q_clustering_distances(spark, sf_dir):
    ctx = NB.PairContext(_em(spark, sf_dir), "euclidean", None, want=NB.CLUSTERING)
    return finish_long(union_all([NB.ft_vdu(ctx), NB.ft_int(ctx), NB.ft_sil(ctx), NB.ft_pb(ctx)]))


# ------------------------------------------------------------- complexity
_NE = "ne AS (SELECT i, min(d) FILTER (WHERE yi <> yj) AS ne, min(d) FILTER (WHERE yi = yj) AS sc FROM g GROUP BY i)"
_NN = "nn AS (SELECT i, yi, first(yj ORDER BY d, j) AS ny FROM g GROUP BY i, yi)"
_N_SQL = with_(EM_CTE, EMM_CTE, G_CTE, _NE, _NN) + sql_long(union([
    row("n2", "1.0 - 1.0 / (1.0 + sc / ne)", attr="(CAST(i AS VARCHAR))", src="FROM ne"),
    row("n3", "CAST(ny <> yi AS DOUBLE)", attr="(CAST(i AS VARCHAR))", src="FROM nn"),
    row("lsc", "1.0 - ((SELECT count(*) FROM g JOIN ne USING (i) WHERE g.d < ne.ne) + "
        "(SELECT count(*) FROM ne WHERE ne > 0)) / power((SELECT count(*) FROM em), 2)", src=ONE),
]))


@query("complexity_neighbourhood", _N_SQL, group="complexity")
def q_complexity_nb(spark, sf_dir):
    ctx = NB.PairContext(_em(spark, sf_dir), "gower", "minmax", want=NB.NEIGHBOURS)
    return finish_long(union_all([NB.ft_n2(ctx), NB.ft_n3(ctx), NB.ft_lsc(ctx)]))


@query("nearest_enemy",
       with_(EM_CTE, EMM_CTE, G_CTE) + f"SELECT i AS row_id, {sql_sig('min(d)')} AS ne_d, arg_min(j, (d, j)) AS ne_id "
       "FROM g WHERE yi <> yj GROUP BY i", group="complexity")
def q_nearest_enemy(spark, sf_dir):
    ctx = NB.PairContext(_em(spark, sf_dir), "gower", "minmax", block_rows=CELL)
    return NB.nearest_enemy(ctx).select("row_id", sig(F.col("ne_d")).alias("ne_d"), "ne_id")


# ---------------------------------------------------------------- concept
_W = ("w AS (SELECT i, yi, yj, d, power(2.0, -2.0 * (d / (CASE WHEN sqrt(4.0) - d <= 0 THEN 1e-9 ELSE sqrt(4.0) - d END))) AS w, "
      "power(2.0, -1.0 * (CASE WHEN ceil(d) = 0 THEN 1.0 ELSE ceil(d) END)) AS wi FROM c)")
_CONCEPT_SQL = with_(EM_CTE, EMM_CTE, C_CTE, _W) + sql_long(union([
    row("conceptvar", "sum(w * CAST(yi <> yj AS DOUBLE)) / sum(w)", attr="(CAST(i AS VARCHAR))", src="FROM w GROUP BY i"),
    row("wg_dist", "sum(w * d) / sum(w)", attr="(CAST(i AS VARCHAR))", src="FROM w GROUP BY i"),
    row("impconceptvar", "sum(wi * CAST(yi <> yj AS DOUBLE))", attr="(CAST(i AS VARCHAR))", src="FROM w GROUP BY i"),
    row("cohesiveness", "sum(wi)", attr="(CAST(i AS VARCHAR))", src="FROM w GROUP BY i"),
]))


@query("concept", _CONCEPT_SQL, group="concept")
def q_concept(spark, sf_dir):
    ctx = NB.concept_context(_em(spark, sf_dir))
    return finish_long(union_all([NB.ft_conceptvar(ctx), NB.ft_wg_dist(ctx), NB.ft_impconceptvar(ctx),
                                  NB.ft_cohesiveness(ctx)]))


# ------------------------------------------------------------- neighbours
_KNN_SQL = with_(EM_CTE, P_CTE) + (
    f"SELECT i AS row_id, CAST(rk AS INTEGER) AS rank, j AS nb_id, {sql_sig('d')} AS nb_dist, yj AS nb_y FROM ("
    "SELECT i, j, d, yj, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p) AS t "
    "WHERE rk <= (SELECT CAST(floor(sqrt(min(n))) AS INTEGER) FROM (SELECT count(*) AS n FROM em GROUP BY y) AS c)")


@query("knn_table", _KNN_SQL, group="clustering")
def q_knn_table(spark, sf_dir):
    t = NB.knn_table(_em(spark, sf_dir), block_rows=2 * CELL)
    return t.select("row_id", F.col("rank").cast("int").alias("rank"), "nb_id", sig(F.col("nb_dist")).alias("nb_dist"), "nb_y")


_VOTE_SQL = with_(EM_CTE, P_CTE) + (
    "SELECT i AS row_id, first(yj ORDER BY v DESC, yj) AS pred FROM ("
    "SELECT i, yj, count(*) AS v FROM (SELECT i, yj, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM p) AS t "
    "WHERE rk <= 5 GROUP BY i, yj) AS u GROUP BY i")


@query("knn_vote", _VOTE_SQL, group="models")
def q_knn_vote(spark, sf_dir):
    return NB.knn_vote(_em(spark, sf_dir), k=5, block_rows=2 * CELL)


@query("complexity_n4", group="complexity")
def q_n4(spark, sf_dir):
    """1-NN error of class-wise interpolated rows (hash-drawn partners and
    blend weights), over cells; rows-only (random draws)."""
    return finish_long(NB.ft_n4(_em(spark, sf_dir)))


@query("complexity_n1", group="complexity")
def q_n1(spark, sf_dir):
    """Share of rows on a spanning-forest edge joining different classes
    (Boruvka on the pair kernel; checked against Prim's algorithm in tests)."""
    return finish_long(NB.ft_n1(_em(spark, sf_dir)))


@query("complexity_t1", group="complexity")
def q_t1(spark, sf_dir):
    """Share of hyperspheres left after absorption (activity rounds on the
    pair kernel; checked against the sequential loop in tests)."""
    return finish_long(NB.ft_t1(_em(spark, sf_dir)))


KNNG_CTE = ("ranked AS (SELECT i, j, yi, yj, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM g), "
            "kk AS (SELECT greatest(1, least(CAST(round(count(*) * 0.15) AS BIGINT), count(*) - 1)) AS k, count(*) AS n FROM em), "
            "kedge AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM ranked, kk WHERE rk <= k AND yi = yj AND d > 0), "
            "deg AS (SELECT v, count(*) AS c FROM (SELECT a AS v FROM kedge UNION ALL SELECT b FROM kedge) AS t GROUP BY v)")
_DENSITY = "(SELECT 1.0 - 2.0 * (SELECT count(*) FROM kedge) / (n * (n - 1.0)) FROM kk)"
_CLS_COEF = ("(SELECT 1.0 - 3.0 * (SELECT count(*) FROM kedge AS e1 JOIN kedge AS e2 ON e1.a = e2.a AND e1.b < e2.b "
             "JOIN kedge AS e3 ON e3.a = e1.b AND e3.b = e2.b) / (SELECT sum(c * (c - 1) / 2.0) FROM deg))")


@query("complexity_density", with_(EM_CTE, EMM_CTE, G_CTE, KNNG_CTE) + sql_long(row("density", _DENSITY, src=ONE)), group="complexity")
def q_density(spark, sf_dir):
    """1 - density of the same-class round(0.15 n)-NN graph, counted on the
    pair kernel without an edge list (checked against a dense graph in tests)."""
    return finish_long(NB.ft_density(_em(spark, sf_dir)))


@query("complexity_cls_coef", with_(EM_CTE, EMM_CTE, G_CTE, KNNG_CTE) + sql_long(row("cls_coef", _CLS_COEF, src=ONE)), group="complexity")
def q_cls_coef(spark, sf_dir):
    """1 - transitivity of the same-class round(0.15 n)-NN graph (wedge join;
    checked against a dense graph in tests)."""
    return finish_long(NB.ft_cls_coef(_em(spark, sf_dir)))


@query("complexity_hubs", group="complexity")
def q_hubs(spark, sf_dir):
    """1 - hub score per row of the k-NN graph, converged (tests hold it
    against the dense eigenvector)."""
    return finish_long(NB.ft_hubs(_em(spark, sf_dir)))
