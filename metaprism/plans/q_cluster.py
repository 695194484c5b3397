"""Registered queries: clustering (K) and complexity (X) features without
row-pair distances, on LI (label l_returnflag)."""

from __future__ import annotations

from ..frame import union_all
from ..operators import clustering as K
from ..operators import complexity as X
from ..sources.tables import lineitem_frame, LI_NUM
from .registry import query, finish_long, sql_long, row, union
from .sqlbind import LI_CTE, with_

NUM = list(LI_NUM)
D = len(NUM)
ONE = "FROM (SELECT 1) AS one"


def _li(spark, sf_dir):
    return lineitem_frame(spark, sf_dir, with_cat=False)


CL_CTE = ("cl AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS k, count(*) AS n, "
          + ", ".join(f"avg({c}) AS m{i}, var_samp({c}) AS v{i}, min({c}) AS lo{i}, max({c}) AS hi{i}"
                      for i, c in enumerate(NUM))
          + " FROM li GROUP BY y)")
GM_CTE = "gm AS (SELECT count(*) AS n, " + ", ".join(f"avg({c}) AS g{i}" for i, c in enumerate(NUM)) + " FROM li)"
PR_CTE = ("pr AS (SELECT a.y AS ya, b.y AS yb, a.n AS na, b.n AS nb, "
          "CAST(a.k * (2 * (SELECT count(*) FROM cl) - a.k - 1) / 2 + (b.k - a.k - 1) AS INTEGER) AS idx, "
          + ", ".join(f"a.lo{i} AS la{i}, a.hi{i} AS ha{i}, b.lo{i} AS lb{i}, b.hi{i} AS hb{i}" for i in range(D))
          + " FROM cl AS a JOIN cl AS b ON a.k < b.k)")


def _f2_expr():
    terms = [f"greatest(0.0, least(ha{i}, hb{i}) - greatest(la{i}, lb{i})) / (greatest(ha{i}, hb{i}) - least(la{i}, lb{i}))"
             for i in range(D)]
    return " * ".join(terms)


def _f3_src():
    cnts = ", ".join(
        f"count(*) FILTER (WHERE li.{c} >= greatest(la{i}, lb{i}) AND li.{c} <= least(ha{i}, hb{i})) AS o{i}"
        for i, c in enumerate(NUM))
    return (f"FROM (SELECT pr.idx, pr.ya, pr.yb, pr.na, pr.nb, {cnts} FROM pr JOIN li ON li.y = pr.ya OR li.y = pr.yb "
            "GROUP BY pr.idx, pr.ya, pr.yb, pr.na, pr.nb) AS t")


_CH = ("(SELECT (b / (k - 1.0)) / (w / (n - k)) FROM (SELECT "
       + " + ".join(f"sum(cl.n * power(cl.m{i} - gm.g{i}, 2))" for i in range(D)) + " AS b, "
       + " + ".join(f"sum((cl.n - 1) * cl.v{i})" for i in range(D)) + " AS w, "
       "count(*) AS k, max(gm.n) AS n FROM cl, gm) AS s)")

_S = ("s AS (SELECT li.y, avg(sqrt(" + " + ".join(f"power(li.{c} - cl.m{i}, 2)" for i, c in enumerate(NUM))
      + ")) AS s FROM li JOIN cl USING (y) GROUP BY li.y)")
_VDB = ("(SELECT avg(r) FROM (SELECT a.y, max((sa.s + sb.s) / sqrt("
        + " + ".join(f"power(a.m{i} - b.m{i}, 2)" for i in range(D))
        + ")) AS r FROM cl AS a JOIN cl AS b ON a.y <> b.y JOIN s AS sa ON sa.y = a.y JOIN s AS sb ON sb.y = b.y "
        "GROUP BY a.y) AS t)")

_NRE = "(SELECT -sum(p * ln(p)) FROM (SELECT n * 1.0 / (SELECT count(*) FROM li) AS p FROM cl) AS t)"

_CLUSTER_SQL = with_(LI_CTE, CL_CTE, GM_CTE, _S) + sql_long(union([
    row("ch", _CH, idx=0, src=ONE),
    row("vdb", _VDB, idx=0, src=ONE),
    row("nre", _NRE, src=ONE),
    row("sc", "(SELECT count(*) FILTER (WHERE n < 15) FROM cl)", src=ONE),
]))


@query("clustering_centroid", _CLUSTER_SQL, group="clustering")
def q_clustering(spark, sf_dir):
    fr = _li(spark, sf_dir)
    return finish_long(union_all([K.ft_ch(fr), K.ft_vdb(fr), K.ft_nre(fr), K.ft_sc(fr)]))


_COMPLEXITY_SQL = with_(LI_CTE, CL_CTE, GM_CTE, PR_CTE) + sql_long(union(
    [row("f1", f"1.0 / (1.0 + sum(cl.n * power(cl.m{i} - gm.g{i}, 2)) / sum((cl.n - 1) * cl.v{i}))",
         attr=c, idx=i, src="FROM cl, gm") for i, c in enumerate(NUM)]
    + [row("f2", _f2_expr(), cls="(ya || '|' || yb)", idx="idx", src="FROM pr")]
    + [row("f3", f"least({', '.join(f'o{i}' for i in range(D))}) * 1.0 / (na + nb)", cls="(ya || '|' || yb)",
           idx="idx", src=_f3_src())]
    + [row("c1", f"{_NRE} / ln((SELECT count(*) FROM cl))", src=ONE),
       row("c2", "1.0 - 1.0 / ((count(*) - 1.0) / count(*) * sum(n * 1.0 / ((SELECT count(*) FROM li) - n)))",
           src="FROM cl"),
       row("t2", f"{float(D)} / count(*)", idx=0, src="FROM li")]
))


@query("complexity_overlap", _COMPLEXITY_SQL, group="complexity")
def q_complexity(spark, sf_dir):
    fr = _li(spark, sf_dir)
    return finish_long(union_all([X.ft_f1(fr), X.ft_f2(fr), X.ft_f3(fr), X.ft_c1(fr), X.ft_c2(fr), X.ft_t2(fr)]))


@query("complexity_f1v_f4", group="complexity")
def q_complexity_iter(spark, sf_dir):
    """f1v (pseudo-inverse on d x d) and f4 (iterative removal): rows-only."""
    fr = _li(spark, sf_dir)
    return finish_long(union_all([X.ft_f1v(fr), X.ft_f4(fr), X.ft_t3(fr), X.ft_t4(fr)]))


@query("complexity_linear", group="complexity")
def q_complexity_linear(spark, sf_dir):
    """l1, l2, l3: linear SVM per class pair on standardised LI columns."""
    li = lineitem_frame(spark, sf_dir, with_cat=False)
    fr = li.with_df(li.df.withColumn("row_id", X.F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
                    row_id="row_id")
    return finish_long(union_all([X.ft_l1(fr, 20), X.ft_l2(fr, 20), X.ft_l3(fr, 20)]))
