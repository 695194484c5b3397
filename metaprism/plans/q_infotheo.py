"""Registered queries: information theory (I) and item sets (J) on LI's C."""

from __future__ import annotations

from ..frame import union_all
from ..operators import infotheory as I
from ..operators import itemset as J
from ..sources.tables import lineitem_frame
from .registry import query, finish_long, sql_long, row, union
from .sqlbind import LI_CTE, LI_CAT, with_

CAT = list(LI_CAT)


def _ent_sql(x: str) -> str:
    return (f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) * 1.0 / sum(count(*)) OVER () AS p "
            f"FROM li GROUP BY {x}) AS e)")


def _grid(x: str, y: str) -> str:
    """Smoothed full grid g(xv, yv, p) of two columns of li."""
    return (f"cnt AS (SELECT {x} AS xv, {y} AS yv, count(*) AS c FROM li GROUP BY 1, 2), "
            f"tot AS (SELECT sum(c) AS n FROM cnt), "
            f"g AS (SELECT xs.xv, ys.yv, coalesce(cnt.c, 0) * 1.0 / tot.n AS q, "
            f"coalesce(cnt.c, 0) * 1.0 / tot.n + 1e-8 AS p "
            f"FROM (SELECT DISTINCT xv FROM cnt) AS xs CROSS JOIN (SELECT DISTINCT yv FROM cnt) AS ys CROSS JOIN tot "
            f"LEFT JOIN cnt ON cnt.xv = xs.xv AND cnt.yv = ys.yv)")


def _joint_sql(x: str) -> str:
    return f"(WITH {_grid(x, 'y')} SELECT -sum(p * log2(p)) FROM g)"


def _conc_sql(x: str, y: str) -> str:
    return (f"(WITH {_grid(x, y)}, cs AS (SELECT yv, sum(p) AS isum FROM g GROUP BY yv), "
            f"rs AS (SELECT xv, sum(p) AS rsum FROM g GROUP BY xv), j AS (SELECT sum(rsum * rsum) AS jsum2 FROM rs) "
            f"SELECT (sum(g.p * g.p / cs.isum) - max(j.jsum2)) / (1 - max(j.jsum2)) FROM g JOIN cs USING (yv), j)")


ONE = "FROM (SELECT 1) AS one"
_MI = {c: f"({_ent_sql(c)} + {_ent_sql('y')} - {_joint_sql(c)})" for c in CAT}
_SUM_MI = "(" + " + ".join(_MI.values()) + ")"
_SUM_AE = "(" + " + ".join(_ent_sql(c) for c in CAT) + ")"

_INFO_SQL = with_(LI_CTE) + sql_long(union(
    [row("attr_ent", _ent_sql(c), attr=c, idx=i, src=ONE) for i, c in enumerate(CAT)]
    + [row("class_ent", _ent_sql("y"), src=ONE)]
    + [row("joint_ent", _joint_sql(c), attr=c, idx=i, src=ONE) for i, c in enumerate(CAT)]
    + [row("mut_inf", _MI[c], attr=c, idx=i, src=ONE) for i, c in enumerate(CAT)]
    + [row("eq_num_attr", f"{float(len(CAT))} * {_ent_sql('y')} / {_SUM_MI}", src=ONE)]
    + [row("ns_ratio", f"({_SUM_AE} - {_SUM_MI}) / {_SUM_MI}", src=ONE)]
    + [row("class_conc", _conc_sql(c, "y"), attr=c, idx=i, src=ONE) for i, c in enumerate(CAT)]
))


def _li(spark, sf_dir):
    return lineitem_frame(spark, sf_dir)


@query("info_theory", _INFO_SQL, group="info-theory")
def q_info_theory(spark, sf_dir):
    fr = _li(spark, sf_dir)
    ct = I.K.attr_class_counts(fr).cache()
    out = union_all([I.ft_attr_ent(fr, ct), I.ft_class_ent(fr), I.ft_joint_ent(fr, ct), I.ft_mut_inf(fr, ct),
                     I.ft_eq_num_attr(fr, ct), I.ft_ns_ratio(fr, ct), I.ft_class_conc(fr, ct)])
    return finish_long(out)


_ORDERED = [(a, b) for a in CAT for b in CAT if a != b]
_ATTR_CONC_SQL = with_(LI_CTE) + sql_long(union([
    row("attr_conc", _conc_sql(a, b), attr=f"{a}|{b}", idx=k, src=ONE) for k, (a, b) in enumerate(_ORDERED)]))


@query("attr_conc", _ATTR_CONC_SQL, group="info-theory")
def q_attr_conc(spark, sf_dir):
    return finish_long(I.ft_attr_conc(_li(spark, sf_dir)))


_ONE_SQL = with_(LI_CTE) + sql_long(union([
    row("one_itemset", "count(*) * 1.0 / (SELECT count(*) FROM li)", attr=f"('{c}=' || CAST({c} AS VARCHAR))",
        idx=i, src=f"FROM li WHERE {c} IS NOT NULL GROUP BY {c}") for i, c in enumerate(CAT)]))


@query("one_itemset", _ONE_SQL, group="itemset")
def q_one_itemset(spark, sf_dir):
    return finish_long(J.ft_one_itemset(_li(spark, sf_dir)))


_PAIRS = [(a, b) for i, a in enumerate(CAT) for b in CAT[i + 1:]]


def _two_sql(k, a, b):
    return row(
        "two_itemset", "(xs.na + ys.nb - 2.0 * coalesce(p.nab, 0)) / (SELECT count(*) FROM li)",
        attr=f"('{a}|{b}:' || xs.va || '|' || ys.vb)", idx=k,
        src=(f"FROM (SELECT CAST({a} AS VARCHAR) AS va, count(*) AS na FROM li GROUP BY 1) AS xs "
             f"CROSS JOIN (SELECT CAST({b} AS VARCHAR) AS vb, count(*) AS nb FROM li GROUP BY 1) AS ys "
             f"LEFT JOIN (SELECT CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb, count(*) AS nab "
             f"FROM li GROUP BY 1, 2) AS p ON p.va = xs.va AND p.vb = ys.vb"))


_TWO_SQL = with_(LI_CTE) + sql_long(union([_two_sql(k, a, b) for k, (a, b) in enumerate(_PAIRS)]))


@query("two_itemset", _TWO_SQL, group="itemset")
def q_two_itemset(spark, sf_dir):
    return finish_long(J.ft_two_itemset(_li(spark, sf_dir)))
