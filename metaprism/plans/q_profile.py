"""Registered queries: general (G) and statistical (A) meta-features on LI."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import union_all
from ..operators import general as G
from ..operators import statistical as S
from ..operators.moments import values_frame
from ..sources.tables import embeddings_frame, lineitem_frame, LI_NUM
from .registry import query, finish_long, sql_long, row, union
from .sqlbind import EM_CTE, LI_CTE, LI_CAT, with_

NUM = list(LI_NUM)
ATTRS = NUM + list(LI_CAT)
NAN_SQL = "CAST('nan' AS DOUBLE)"


# ---------------------------------------------------------------- SQL twins
def _mom(c: str) -> str:
    """Subquery with n, central power sums s2..s4 and min of one column."""
    return (f"FROM (SELECT count({c}) AS n, sum(power({c} - mu, 2)) AS s2, sum(power({c} - mu, 3)) AS s3, "
            f"sum(power({c} - mu, 4)) AS s4 FROM li, (SELECT avg({c}) AS mu FROM li) AS m) AS z")


COL_SQL = {
    "mean": lambda c: (f"avg({c})", "FROM li"),
    "sd": lambda c: (f"stddev_samp({c})", "FROM li"),
    "var": lambda c: (f"var_samp({c})", "FROM li"),
    "min": lambda c: (f"min({c})", "FROM li"),
    "max": lambda c: (f"max({c})", "FROM li"),
    "range": lambda c: (f"max({c}) - min({c})", "FROM li"),
    "median": lambda c: (f"quantile_cont({c}, 0.5)", "FROM li"),
    "iq_range": lambda c: (f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "FROM li"),
    "kurtosis": lambda c: ("(n * s4 / (s2 * s2)) * power(1 - 1.0 / n, 2) - 3", _mom(c)),
    "skewness": lambda c: ("sqrt(n) * s3 / power(s2, 1.5) * power((n - 1.0) / n, 1.5)", _mom(c)),
    "g_mean": lambda c: (f"CASE WHEN min({c}) < 0 THEN {NAN_SQL} WHEN min({c}) < 1e-10 THEN 0.0 "
                         f"ELSE exp(avg(ln(CASE WHEN {c} > 0 THEN {c} END))) END", "FROM li"),
    "h_mean": lambda c: (f"CASE WHEN min({c}) < 0 THEN {NAN_SQL} WHEN min({c}) = 0 THEN 0.0 "
                         f"ELSE count({c}) / sum(1.0 / {c}) END", "FROM li"),
}


def col_features_sql(features, by_class=False) -> str:
    return with_(LI_CTE) + sql_long(col_features_union(features, by_class))


def col_features_union(features, by_class=False) -> str:
    parts = []
    for f in features:
        for i, c in enumerate(NUM):
            expr, src = COL_SQL[f](c)
            if by_class:
                parts.append(row(f, expr, attr=c, cls="y", idx=i, src=f"{src} GROUP BY y"))
            else:
                parts.append(row(f, expr, attr=c, idx=i, src=src))
    return union(parts)


def _li(spark, sf_dir):
    return lineitem_frame(spark, sf_dir)


# ------------------------------------------------------------------ queries
@query("class_profile", col_features_sql(["mean", "sd"], by_class=True), group="statistical")
def q_class_profile(spark, sf_dir):
    """Flagship: class-conditional mean and sd of every numeric LI column."""
    return finish_long(S.column_features(_li(spark, sf_dir), ["mean", "sd"], by_class=True))


ALL_COL = list(S.COLUMN_FEATURES)


@query("stat_column_features", col_features_sql(ALL_COL), group="statistical")
def q_stat_columns(spark, sf_dir):
    return finish_long(S.column_features(_li(spark, sf_dir), ALL_COL))


@query("class_quartiles", col_features_sql(["median", "iq_range"], by_class=True), group="statistical")
def q_class_quartiles(spark, sf_dir):
    return finish_long(S.column_features(_li(spark, sf_dir), ["median", "iq_range"], by_class=True))


_MAD_SQL = with_(LI_CTE) + sql_long(union([
    row("mad", f"quantile_cont(abs({c} - med), 0.5) * 1.4826", attr=c, idx=i,
        src=f"FROM li, (SELECT quantile_cont({c}, 0.5) AS med FROM li) AS m")
    for i, c in enumerate(NUM)]))


@query("stat_mad", _MAD_SQL, group="statistical")
def q_stat_mad(spark, sf_dir):
    return finish_long(S.ft_mad(_li(spark, sf_dir)))


_TMEAN_SQL = with_(LI_CTE) + sql_long(union([
    row("t_mean", f"avg({c})", attr=c, idx=i,
        src=(f"FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM li) AS t "
             f"WHERE r >= floor(0.2 * n) AND r < n - floor(0.2 * n)"))
    for i, c in enumerate(NUM)]))


@query("stat_t_mean", _TMEAN_SQL, group="statistical")
def q_stat_t_mean(spark, sf_dir):
    return finish_long(S.ft_t_mean(_li(spark, sf_dir)))


_PAIRS = [(i, j) for i in range(len(NUM)) for j in range(i)]


def _pair_sql(name, fn):
    return with_(LI_CTE) + sql_long(union([
        row(name, f"abs({fn}({NUM[i]}, {NUM[j]}))", attr=f"{NUM[i]}|{NUM[j]}", idx=k, src="FROM li")
        for k, (i, j) in enumerate(_PAIRS)]))


@query("stat_cor", _pair_sql("cor", "corr"), group="statistical")
def q_stat_cor(spark, sf_dir):
    return finish_long(S.ft_cor(_li(spark, sf_dir)))


@query("stat_cov", _pair_sql("cov", "covar_samp"), group="statistical")
def q_stat_cov(spark, sf_dir):
    return finish_long(S.ft_cov(_li(spark, sf_dir)))


_NRCOR_SQL = with_(LI_CTE) + sql_long(row(
    "nr_cor_attr",
    "(" + " + ".join(f"CAST(abs(corr({NUM[i]}, {NUM[j]})) >= 0.5 AS DOUBLE)" for i, j in _PAIRS)
    + f") * {2.0 / (len(NUM) * (len(NUM) - 1))}", src="FROM li"))


@query("stat_nr_cor_attr", _NRCOR_SQL, group="statistical")
def q_stat_nr_cor_attr(spark, sf_dir):
    return finish_long(S.ft_nr_cor_attr(_li(spark, sf_dir)))


def _outlier_term(c):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return (f"CAST(({q1} - 1.5 * ({q3} - {q1}) > min({c})) OR ({q3} + 1.5 * ({q3} - {q1}) < max({c})) AS DOUBLE)")


_NROUT_SQL = with_(LI_CTE) + sql_long(row("nr_outliers", " + ".join(_outlier_term(c) for c in NUM), src="FROM li"))


@query("stat_nr_outliers", _NROUT_SQL, group="statistical")
def q_stat_nr_outliers(spark, sf_dir):
    return finish_long(S.ft_nr_outliers(_li(spark, sf_dir)))


_SPARS_SQL = with_(LI_CTE) + sql_long(union([
    row("sparsity", f"(count(*) * 1.0 / count(DISTINCT {c}) - 1.0) / (count(*) - 1.0)", attr=c, idx=i, src="FROM li")
    for i, c in enumerate(ATTRS)]))


@query("stat_sparsity", _SPARS_SQL, group="statistical")
def q_stat_sparsity(spark, sf_dir):
    return finish_long(S.ft_sparsity(_li(spark, sf_dir)))


_GRAV_SQL = with_(LI_CTE, "c AS (SELECT y, count(*) AS cnt, " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(NUM))
                  + " FROM li GROUP BY y)",
                  "mj AS (SELECT * FROM c ORDER BY cnt DESC, y ASC LIMIT 1)",
                  "mn AS (SELECT * FROM c WHERE y <> (SELECT y FROM mj) ORDER BY cnt ASC, y ASC LIMIT 1)") + sql_long(
    row("gravity", "sqrt(" + " + ".join(f"power(mj.m{i} - mn.m{i}, 2)" for i in range(len(NUM))) + ")",
        idx=0, src="FROM mj, mn"))


@query("stat_gravity", _GRAV_SQL, group="statistical")
def q_stat_gravity(spark, sf_dir):
    return finish_long(S.ft_gravity(_li(spark, sf_dir)))


# Driver-algebra features: d x d results of one distributed aggregate.
@query("stat_eigenvalues", group="statistical")
def q_stat_eigenvalues(spark, sf_dir):
    return finish_long(S.ft_eigenvalues(_li(spark, sf_dir)))


@query("stat_discriminant", group="statistical")
def q_stat_discriminant(spark, sf_dir):
    fr = _li(spark, sf_dir)
    return finish_long(union_all([S.ft_can_cor(fr), S.ft_nr_disc(fr), S.ft_w_lambda(fr), S.ft_p_trace(fr),
                                  S.ft_lh_trace(fr), S.ft_roy_root(fr), S.ft_sd_ratio(fr)]))


def _normality_sql(values: str) -> str:
    """Columns of ``values`` (attr, x) whose K^2 p-value, exp(-K^2 / 2) with two
    degrees of freedom, is over 0.05 (published forms of both z-scores)."""
    return f"""SELECT 'nr_norm' AS feature, NULL AS attr, NULL AS cls, 0 AS idx, CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT *, (1 - 2 / (9 * a) - (CASE WHEN q < 0 THEN -1 ELSE 1 END) * power(abs((1 - 2 / a) / q), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM (
    SELECT attr, z1, a, 1 + x * sqrt(2 / (a - 4)) AS q FROM (
      SELECT *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM (
        SELECT attr,
          asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
          (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (power(n + 1, 2) * (n + 3) * (n + 5))) AS x,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb
        FROM (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
            -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2
          FROM (SELECT attr, CAST(count(*) AS DOUBLE) AS n, avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS g1,
              avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) AS b2
            FROM (SELECT attr, x, avg(x) OVER (PARTITION BY attr) AS mu FROM ({values}) AS v0) AS v1 GROUP BY attr) AS m) AS s) AS k) AS c) AS e
) AS t WHERE exp(-(z1 * z1 + z2 * z2) / 2) > 0.05"""


@query("stat_nr_norm", with_(LI_CTE) + sql_long(_normality_sql(
    " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST({c} AS DOUBLE) AS x FROM li WHERE {c} IS NOT NULL" for c in NUM))), group="statistical")
def q_stat_nr_norm(spark, sf_dir):
    return finish_long(S.ft_nr_norm(_li(spark, sf_dir)))


EM_WIDTH = 64  # length of the embeddings


@query("stat_nr_norm_wide", sql_long(_normality_sql(
    f"SELECT i AS attr, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, {EM_WIDTH + 1}) AS r(i)")), group="statistical")
def q_stat_nr_norm_wide(spark, sf_dir):
    """Normality of every embedding element."""
    return finish_long(S.ft_nr_norm(embeddings_frame(spark, sf_dir, dims=EM_WIDTH)))


@query("stat_nr_norm_rank", group="statistical")
def q_stat_nr_norm_rank(spark, sf_dir):
    """Normal columns by the rank-based tests and by all three, and the
    statistics behind them."""
    fr = _li(spark, sf_dir)
    counts = [S.ft_nr_norm(fr, m, failure=f).withColumn("cls", F.lit(f"{m} {f}"))
              for m, f in (("shapiro-wilk", "soft"), ("anderson-darling", "soft"), ("all", "soft"), ("all", "hard"))]
    found = S.normality_statistics(fr)
    stats = [values_frame(spark, k, [found[c][k] for c in NUM], NUM) for k in ("w", "a2")]
    return finish_long(union_all(counts + stats))


_PAIR_SUMS = "FROM em_long a JOIN em_long b ON a.row_id = b.row_id AND b.i < a.i GROUP BY a.i, b.i"
_WIDE_SQL = (f"WITH em_long AS (SELECT vec_id AS row_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, {EM_WIDTH + 1}) AS r(i)) "
             + sql_long(union([row(name, f"abs({fn}(a.x, b.x))", attr="('e' || a.i || '|e' || b.i)", idx="CAST(a.i * (a.i - 1) // 2 + b.i AS INTEGER)",
                                   src=_PAIR_SUMS) for name, fn in (("cov", "covar_samp"), ("cor", "corr"))])))


@query("stat_pairs_wide", _WIDE_SQL, group="statistical")
def q_stat_pairs_wide(spark, sf_dir):
    """Covariances and correlations of all pairs of embedding elements by the
    blocked kernel, ten pairs of blocks."""
    fr = embeddings_frame(spark, sf_dir, dims=EM_WIDTH)
    return finish_long(S.ft_cov(fr, blocked=True, size=16).unionByName(S.ft_cor(fr, blocked=True, size=16)))


# Two columns: W^-1 B is 2 x 2, its eigenvalues l1 >= l2 those of trace and determinant.
_TWO_SQL = with_(EM_CTE, """k AS (SELECT y, CAST(count(*) AS DOUBLE) AS n, avg(e0) AS m0, avg(e1) AS m1,
    var_samp(e0) AS v0, var_samp(e1) AS v1, covar_samp(e0, e1) AS c FROM em GROUP BY y)""",
    "g AS (SELECT sum(n) AS n, sum(n * m0) / sum(n) AS g0, sum(n * m1) / sum(n) AS g1, CAST(count(*) AS DOUBLE) AS k FROM k)",
    """s AS (SELECT sum((k.n - 1) * v0) AS wa, sum((k.n - 1) * c) AS wb, sum((k.n - 1) * v1) AS wd,
    sum(k.n * power(m0 - g0, 2)) AS ba, sum(k.n * (m0 - g0) * (m1 - g1)) AS bb, sum(k.n * power(m1 - g1, 2)) AS bd,
    sum(1 / (k.n - 1)) AS inv, sum((k.n - 1) * ln(v0 * v1 - c * c)) AS logs, max(g.n) AS n, max(g.k) AS k FROM k, g)""",
    """t AS (SELECT *, (wd * ba - 2 * wb * bb + wa * bd) / (wa * wd - wb * wb) AS tr,
    (ba * bd - bb * bb) / (wa * wd - wb * wb) AS det, (wa + ba) / (n - 1) AS ta, (wb + bb) / (n - 1) AS tb, (wd + bd) / (n - 1) AS td FROM s)""",
    "l AS (SELECT *, tr / 2 + sqrt(tr * tr / 4 - det) AS l1, tr / 2 - sqrt(tr * tr / 4 - det) AS l2, "
    "1 - 13.0 / (18 * (k - 1)) * (inv - 1 / (n - k)) AS gam FROM t)") + sql_long(union([
        row("can_cor", "sqrt(l1 / (1 + l1))", src="FROM l"), row("can_cor", "sqrt(l2 / (1 + l2))", idx=1, src="FROM l"),
        row("nr_disc", "least(2, k - 1)", src="FROM l"), row("w_lambda", "1 / ((1 + l1) * (1 + l2))", src="FROM l"),
        row("p_trace", "l1 / (1 + l1) + l2 / (1 + l2)", src="FROM l"), row("lh_trace", "l1 + l2", src="FROM l"),
        row("roy_root", "l1", src="FROM l"),
        row("sd_ratio", "exp(gam * ((n - k) * ln((wa * wd - wb * wb) / power(n - k, 2)) - logs) / (2 * (n - k)))", src="FROM l"),
        row("eigenvalues", "(ta + td) / 2 - sqrt(power((ta - td) / 2, 2) + tb * tb)", src="FROM l"),
        row("eigenvalues", "(ta + td) / 2 + sqrt(power((ta - td) / 2, 2) + tb * tb)", idx=1, src="FROM l")]))


@query("stat_discriminant_two", _TWO_SQL, group="statistical")
def q_stat_discriminant_two(spark, sf_dir):
    """The discriminant features and eigenvalues of two columns, where SQL has a
    closed form for them."""
    fr = embeddings_frame(spark, sf_dir, dims=2)
    return finish_long(union_all([S.ft_can_cor(fr), S.ft_nr_disc(fr), S.ft_w_lambda(fr), S.ft_p_trace(fr),
                                  S.ft_lh_trace(fr), S.ft_roy_root(fr), S.ft_sd_ratio(fr), S.ft_eigenvalues(fr)]))


# ------------------------------------------------------------------ general
_GEN_SQL = with_(LI_CTE) + sql_long(union([
    row("nr_inst", "count(*)", src="FROM li"),
    row("nr_attr", f"{float(len(ATTRS))}", src="FROM (SELECT 1) AS one"),
    row("nr_num", f"{float(len(NUM))}", src="FROM (SELECT 1) AS one"),
    row("nr_cat", f"{float(len(LI_CAT))}", src="FROM (SELECT 1) AS one"),
    row("attr_to_inst", f"{float(len(ATTRS))} / count(*)", src="FROM li"),
    row("inst_to_attr", f"count(*) / {float(len(ATTRS))}", src="FROM li"),
    row("cat_to_num", f"{len(LI_CAT) / len(NUM)}", src="FROM (SELECT 1) AS one"),
    row("num_to_cat", f"{len(NUM) / len(LI_CAT)}", src="FROM (SELECT 1) AS one"),
    row("nr_bin", " + ".join(f"CAST(count(DISTINCT {c}) = 2 AS DOUBLE)" for c in ATTRS), src="FROM li"),
    row("nr_class", "count(DISTINCT y)", src="FROM li"),
    row("freq_class", "count(*) * 1.0 / (SELECT count(*) FROM li)", cls="y", src="FROM li GROUP BY y"),
]))


@query("general", _GEN_SQL, group="general")
def q_general(spark, sf_dir):
    fr = _li(spark, sf_dir)
    return finish_long(union_all([fn(fr) for fn in G.FEATURES.values()]))
