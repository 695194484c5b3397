"""Registered queries: typing/encoding (T) and result shaping (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame, union_all
from ..functions.orderstats import distinct_values
from ..functions.numeric import sig, sql_sig
from ..functions.summaries import summarise
from ..operators import encoding as T
from ..operators import general as G
from ..operators import shaping as U
from ..operators import statistical as S
from ..session import read_table
from ..sources.tables import lineitem_frame, LI_NUM, LI_KEY
from .extract import catalogue_df
from .q_phases import lin_frame, LIN_CTE
from .q_profile import col_features_union, _GEN_SQL
from .registry import query
from .sqlbind import LI_CTE, with_

NUM = list(LI_NUM)
KEYS = ", ".join(LI_KEY)


# --------------------------------------------------------------- T5 bins
def _edges_sql(c: str) -> str:
    return (
        f"s_{c} AS (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS r FROM li), "
        f"p_{c} AS (SELECT fq.i, fq.q * (nb.n - 1) AS pos FROM fq CROSS JOIN nb), "
        f"e_{c} AS (SELECT p.i, CASE WHEN lo.x = hi.x THEN lo.x ELSE (ceil(p.pos) - p.pos) * lo.x + "
        f"(p.pos - floor(p.pos)) * hi.x END AS e FROM p_{c} AS p JOIN s_{c} AS lo ON lo.r = floor(p.pos) "
        f"JOIN s_{c} AS hi ON hi.r = ceil(p.pos)), "
        f"k_{c} AS (SELECT DISTINCT e FROM (SELECT e, i, lag(e) OVER (ORDER BY i) AS pe FROM e_{c}) AS t "
        f"WHERE pe IS NULL OR e - pe > 1e-8)")


_BIN_SQL = (with_(LI_CTE, "nb AS (SELECT count(*) AS n, CAST(floor(power(count(*), 1.0 / 3)) AS INTEGER) AS b FROM li)",
                  "fq AS (SELECT t.i, t.i * 1.0 / nb.b AS q FROM range(1, 10001) AS t(i), nb WHERE t.i <= nb.b)",
                  *[_edges_sql(c) for c in NUM])
            + f"SELECT {KEYS}, " + ", ".join(
                f"CAST((SELECT count(*) FROM k_{c} WHERE k_{c}.e < li.{c}) AS INTEGER) AS {c}" for c in NUM)
            + " FROM li")


@query("discretise_equal_freq", _BIN_SQL, group="typing")
def q_discretise(spark, sf_dir):
    fr = lineitem_frame(spark, sf_dir, with_cat=False)
    out = T.discretise_equal_freq(fr)
    return out.df.select(*LI_KEY, *NUM)


# ------------------------------------------------------------- T2-T4 codes
def _cat_frame(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        *LI_KEY, "l_linestatus", F.col("l_linenumber").cast("string").alias("l_linenumber_s"),
        F.col("l_returnflag").alias("y"))
    return Frame(df=li, num=(), cat=("l_linestatus", "l_linenumber_s"), label="y", name="lineitem")


CAT_CTE = ("lc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, "
           "CAST(l_linenumber AS VARCHAR) AS l_linenumber_s FROM lineitem)")


def _long_codes(fr_out: Frame):
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in fr_out.num]
    return fr_out.df.select(*LI_KEY, F.inline(F.array(*items)))


def _onehot_sql(cols_fmt: list[tuple[str, str, str]]) -> str:
    """cols_fmt: (column, name prefix/format, level filter) -> long rows."""
    parts = []
    for c, name_expr, cond in cols_fmt:
        parts.append(
            f"SELECT {KEYS}, {name_expr} AS column_name, CAST(lc.{c} = l.v AS DOUBLE) AS value FROM lc CROSS JOIN "
            f"(SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM lc) AS d) AS l "
            f"WHERE {cond}")
    return with_(CAT_CTE) + " UNION ALL ".join(parts)


@query("encode_onehot", _onehot_sql([(c, f"'{c}_' || l.v", "l.rn > 1") for c in ("l_linestatus", "l_linenumber_s")]),
       group="typing")
def q_onehot(spark, sf_dir):
    return _long_codes(T.encode_onehot(_cat_frame(spark, sf_dir)))


@query("encode_onehot_full", _onehot_sql([(c, f"'{c}_' || l.v", "TRUE") for c in ("l_linestatus", "l_linenumber_s")]),
       group="typing")
def q_onehot_full(spark, sf_dir):
    return _long_codes(T.encode_onehot(_cat_frame(spark, sf_dir), use_all_columns=True))


@query("encode_dummies_reduced", _onehot_sql([("l_linestatus", "'l_linestatus[' || l.v || ']'", "TRUE"),
                                              ("l_linenumber_s", "'l_linenumber_s[T.' || l.v || ']'", "l.rn > 1")]),
       group="typing")
def q_gray(spark, sf_dir):
    return _long_codes(T.encode_dummies_reduced(_cat_frame(spark, sf_dir)))


@query("class_index",
       "SELECT a.y AS cls_a, b.y AS cls_b, a.n AS cnt_a, b.n AS cnt_b FROM (SELECT l_returnflag AS y, count(*) AS n "
       "FROM lineitem GROUP BY 1) AS a JOIN (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1) AS b "
       "ON a.y < b.y", group="typing")
def q_class_index(spark, sf_dir):
    cc, pairs = T.class_index(_cat_frame(spark, sf_dir))
    a = cc.select(F.col("cls").alias("cls_a"), F.col("cnt").alias("cnt_a"))
    b = cc.select(F.col("cls").alias("cls_b"), F.col("cnt").alias("cnt_b"))
    return pairs.join(a, "cls_a").join(b, "cls_b").select("cls_a", "cls_b", "cnt_a", "cnt_b")


@query("label_code",
       f"SELECT {KEYS}, CAST(d.code AS BIGINT) AS l_quantity FROM lineitem JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 "
       "AS code FROM (SELECT DISTINCT l_quantity AS v FROM lineitem) AS t) AS d ON d.v = lineitem.l_quantity",
       group="typing")
def q_label_code(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(*LI_KEY, "l_quantity")
    return T.label_code(li, "l_quantity").select(*LI_KEY, F.col("l_quantity").cast("long").alias("l_quantity"))


@query("infer_num_cat",
       "SELECT column_name, CASE WHEN data_type IN ('VARCHAR') THEN 'cat' "
       "WHEN column_name = 'l_linestatus' THEN 'cat' ELSE 'num' END AS kind FROM information_schema.columns "
       "WHERE table_name = 'lineitem' AND data_type NOT IN ('TIMESTAMP', 'TIMESTAMP_NS', 'DATE')", group="typing")
def q_infer(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").drop("l_shipdate")
    num, cat = T.infer_num_cat(li)
    rows = [(c, "num") for c in num] + [(c, "cat") for c in cat]
    return spark.createDataFrame(rows, "column_name string, kind string")


# ---------------------------------------------------------------- shaping
_PROFILE_FEATS = ["mean", "median", "min", "max", "var", "sd", "iq_range"]


@query("column_profile",
       with_(LI_CTE) + f"SELECT attr, feature || '.mean' AS name, round_even(value, 2) AS value FROM "
       f"({col_features_union(_PROFILE_FEATS)}) AS t WHERE value IS NOT NULL AND NOT isnan(value)", group="shaping")
def q_column_profile(spark, sf_dir):
    long = S.column_features(lineitem_frame(spark, sf_dir), _PROFILE_FEATS)
    return U.column_profile(long).select("attr", "name", "value")


def _summ_sql() -> str:
    lf = col_features_union(list(S.COLUMN_FEATURES))
    return (with_(LI_CTE, f"lf AS ({lf})") +
            "SELECT name, CASE WHEN value IS NULL OR isnan(value) THEN -1111.0 WHEN isinf(value) THEN 2222.0 "
            "ELSE round_even(value, 2) END AS value FROM ("
            "SELECT feature || '.mean' AS name, avg(value) AS value FROM lf GROUP BY feature UNION ALL "
            "SELECT feature || '.sd' AS name, stddev_samp(value) AS value FROM lf GROUP BY feature) AS s")


@query("sanitise_values", _summ_sql(), group="shaping")
def q_sanitise(spark, sf_dir):
    long = S.column_features(lineitem_frame(spark, sf_dir))
    return U.sanitise_values(summarise(long, ("mean", "sd"), vector_features=set(S.COLUMN_FEATURES)))


@query("drop_sentinels", f"SELECT * FROM ({_summ_sql()}) AS t WHERE value NOT IN (-1111.0, 2222.0)", group="shaping")
def q_drop_sentinels(spark, sf_dir):
    long = S.column_features(lineitem_frame(spark, sf_dir))
    return U.drop_sentinels(U.sanitise_values(summarise(long, ("mean", "sd"), vector_features=set(S.COLUMN_FEATURES))))


def _catalogue_sql(groups):
    from .extract import CATALOGUE
    rows, pos = [], 0
    for g in groups:
        for f, vec in CATALOGUE[g].items():
            for nm in ([f"{f}.mean", f"{f}.sd"] if vec else [f]):
                rows.append(f"('{g}', '{nm}', {pos})")
                pos += 1
    return "cat(grp, name, pos) AS (VALUES " + ", ".join(rows) + ")"


_GEN_RES = (f"res AS (SELECT CASE WHEN feature = 'freq_class' THEN NULL ELSE feature END AS name, value FROM "
            f"({_GEN_SQL.replace('WITH ', '', 1).split(') SELECT', 1)[0]}) SELECT 1) AS z)")


def _gen_results_sql() -> str:
    # general features on LI, freq_class summarised by mean and sd
    inner = _GEN_SQL
    return (f"res AS (SELECT feature AS name, value FROM ({inner}) AS g WHERE feature <> 'freq_class' "
            f"UNION ALL SELECT 'freq_class.mean', avg(value) FROM ({inner}) AS g WHERE feature = 'freq_class' "
            f"UNION ALL SELECT 'freq_class.sd', stddev_samp(value) FROM ({inner}) AS g WHERE feature = 'freq_class')")


def _filled(spark, sf_dir):
    fr = lineitem_frame(spark, sf_dir)
    res = summarise(union_all([fn(fr) for fn in G.FEATURES.values()]), ("mean", "sd"), vector_features={"freq_class"})
    res = res.select("name", sig(F.col("value")).alias("value"))
    cat = catalogue_df(spark).where(F.col("group").isin("general", "info-theory"))
    from pyspark.sql import Window
    cat = cat.withColumn("pos", (F.row_number().over(Window.orderBy(
        F.when(F.col("group") == "general", 0).otherwise(1), "feature", "name")) - 1).cast("int"))  # catalogue: ~40 rows
    return U.fill_fixed_schema(res, cat.select("group", "name", "pos"))


def _fill_sql() -> str:
    from .extract import CATALOGUE
    rows, pos = [], 0
    for g in ("general", "info-theory"):
        for f in sorted(CATALOGUE[g]):
            for nm in ([f"{f}.mean", f"{f}.sd"] if CATALOGUE[g][f] else [f]):
                rows.append(f"('{g}', '{nm}', {pos})")
                pos += 1
    cat = "cat(grp, name, pos) AS (VALUES " + ", ".join(rows) + ")"
    return with_(cat, _gen_results_sql()) + (
        "SELECT cat.grp AS \"group\", cat.name, CAST(cat.pos AS INTEGER) AS pos, "
        f"coalesce({sql_sig('res.value')}, -1111.0) AS value FROM cat LEFT JOIN res ON res.name = cat.name")


@query("fill_fixed_schema", _fill_sql(), group="shaping")
def q_fill(spark, sf_dir):
    return _filled(spark, sf_dir).select("group", "name", F.col("pos").cast("int").alias("pos"), "value")


@query("vectorise_features",
       f"SELECT list(value ORDER BY pos) || [1.0, 0.0, 0.0] AS vector FROM ({_fill_sql()}) AS f", group="shaping")
def q_vectorise(spark, sf_dir):
    return U.vectorise_features(_filled(spark, sf_dir), task="clasificacion")


@query("count_missing_columns",
       f"WITH {LIN_CTE} SELECT CAST(" + " + ".join(
           [f"max(CAST({c} IS NULL AS INTEGER))" for c in NUM]
           + ["max(CAST(l_linestatus IS NULL OR lower(trim(l_linestatus)) IN ('', 'na', 'n/a', 'null', 'none') AS INTEGER))"])
       + " AS DOUBLE) AS num_columnas_con_valores_faltantes FROM lin", group="shaping")
def q_missing(spark, sf_dir):
    return U.count_missing_columns(lin_frame(spark, sf_dir))


@query("count_duplicates",
       "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_returnflag, l_linestatus FROM lineitem) AS d) "
       "AS DOUBLE) AS num_registros_duplicados FROM lineitem", group="shaping")
def q_duplicates(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    fr = Frame(df=li, num=("l_quantity",), cat=("l_returnflag", "l_linestatus"))
    return U.count_duplicates(fr)


@query("dataset_size_kb", group="shaping")
def q_size(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return U.dataset_size_kb(Frame(df=li))


@query("format_report",
       f"WITH f AS ({_fill_sql()}) SELECT string_agg(b, '' ORDER BY grp) AS report FROM ("
       "SELECT \"group\" AS grp, 'Grupo: ' || \"group\" || chr(10) || string_agg(name || ': ' || "
       "CAST(CASE WHEN value IN (-1111.0, 2222.0) THEN value ELSE round_even(value, 2) END AS VARCHAR) || chr(10), '' "
       "ORDER BY name) AS b FROM f GROUP BY \"group\") AS t", group="shaping")
def q_report(spark, sf_dir):
    return U.format_report(U.sanitise_values(_filled(spark, sf_dir)))


# ------------------------------------------------------- T6 / P37 / KX1 / T7-T8
@query("rescale_numeric",
       f"SELECT {KEYS}, " + ", ".join(
           f"{sql_sig(f'({c} - (SELECT min({c}) FROM lineitem)) / (SELECT CASE WHEN max({c}) = min({c}) THEN 1.0 ELSE max({c}) - min({c}) END FROM lineitem)')} AS {c}"
           for c in NUM) + " FROM lineitem", group="typing")
def q_rescale(spark, sf_dir):
    out = T.rescale_numeric(lineitem_frame(spark, sf_dir, with_cat=False), "min-max")
    return out.df.select(*LI_KEY, *[sig(F.col(c)).alias(c) for c in NUM])


@query("standardise_matrix",
       f"SELECT {KEYS}, " + ", ".join(
           f"{sql_sig(f'({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM lineitem)')} AS {c}"
           for c in NUM) + " FROM lineitem", group="phases")
def q_standardise(spark, sf_dir):
    from ..operators import phases as P
    fr = lineitem_frame(spark, sf_dir, with_cat=False)
    out = P.standardise_matrix(fr).transform(fr)
    return out.df.select(*LI_KEY, *[sig(F.col(c)).alias(c) for c in NUM])


@query("class_centers",
       "SELECT l_returnflag AS cls, count(*) AS cnt, " + ", ".join(
           f"{sql_sig(f'avg({c})')} AS c{i}" for i, c in enumerate(NUM)) + " FROM lineitem GROUP BY 1",
       group="clustering")
def q_class_centers(spark, sf_dir):
    from ..operators import clustering as K
    cent = K.class_centroids(lineitem_frame(spark, sf_dir, with_cat=False))
    return cent.select("cls", "cnt", *[sig(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(NUM))])


@query("class_centers_median",
       "SELECT l_returnflag AS cls, count(*) AS cnt, " + ", ".join(
           f"{sql_sig(f'quantile_cont({c}, 0.5)')} AS c{i}" for i, c in enumerate(NUM)) + " FROM lineitem GROUP BY 1",
       group="clustering")
def q_class_centers_median(spark, sf_dir):
    from ..operators import clustering as K
    cent = K.class_centroids(lineitem_frame(spark, sf_dir, with_cat=False), "median")
    return cent.select("cls", "cnt", *[sig(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(NUM))])


@query("build_views", group="typing")
def q_build_views(spark, sf_dir):
    """Categorical view (text columns + equal-frequency codes of the
    numeric columns) and numeric view (numeric columns + reduced dummies),
    reported as (view, column, distinct values)."""
    fr = lineitem_frame(spark, sf_dir)
    c_view = T.build_C(fr)
    n_view = T.build_N(fr, "gray")
    parts = []
    for view, f in (("C", c_view), ("N", n_view)):
        cols = list(f.cat if view == "C" else f.num)
        parts += [(view, c, n) for c, n in distinct_values(f.df, {c: F.col(f"`{c}`") for c in cols}).items()]
    return spark.createDataFrame(parts, "view string, column_name string, distinct_values long")


@query("parse_by_group", group="shaping")
def q_parse_by_group(spark, sf_dir):
    """Keep only the statistical results of a default extraction."""
    from .extract import extract, parse_by_group
    res = extract(lineitem_frame(spark, sf_dir), groups=("general", "statistical"))
    return parse_by_group(res, ["statistical"]).select("name", sig(F.col("value")).alias("value"))
