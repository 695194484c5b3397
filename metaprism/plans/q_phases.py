"""Registered queries: preprocessing phases (P) - fit on the table, apply to it.

Outputs are the row key plus the transformed columns (FIXTURES.md section 4);
phases that shape the schema (one-hot) are reported in long form
``(key, column, value)`` so that the SQL twin needs no data-dependent schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.numeric import sig, sql_sig
from ..operators import phases as P
from ..session import read_table
from ..sources.tables import LI_NUM
from .registry import query

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NAN_SQL = "CAST('nan' AS DOUBLE)"


def lin_frame(spark, sf_dir) -> Frame:
    """LI with nulls made by rule (quantity: orderkey % 7 = 0; linestatus: % 11 = 0)."""
    li = read_table(spark, sf_dir, "lineitem")
    df = li.select(
        *KEY,
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("l_linestatus"),
        F.col("l_returnflag").alias("y"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),  # portable draw key
    )
    return Frame(df=df, num=LI_NUM, cat=("l_linestatus",), label="y", row_id="row_id", name="lineitem_nulls")


LIN_CTE = (
    "lin AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
    "l_extendedprice, l_discount, l_tax, "
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus, "
    "l_returnflag AS y FROM lineitem)"
)
KEYS_SQL = ", ".join(KEY)


def _out(fr: Frame, cols, key=KEY):
    return fr.df.select(*key, *[sig(F.col(c)).alias(c) if c in fr.num else F.col(c) for c in cols])


# ------------------------------------------------------------ numeric impute
_IMPUTE = {
    "media": "round_even(avg(l_quantity), 2)",
    "mediana": "round_even(quantile_cont(l_quantity, 0.5), 2)",
    "media_geometrica": "round_even(exp(avg(ln(CASE WHEN l_quantity > 0 THEN l_quantity END))), 2)",
    "moda": "(SELECT l_quantity FROM lin WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_quantity LIMIT 1)",
}


def _impute_num_query(option, expr):
    src = "" if expr.startswith("(SELECT") else " FROM lin"
    sql = (f"WITH {LIN_CTE}, p AS (SELECT {expr} AS v{src}) "
           f"SELECT {KEYS_SQL}, {sql_sig('coalesce(l_quantity, p.v)')} AS l_quantity FROM lin, p")

    @query(f"impute_num_{option}", sql, group="phases")
    def q(spark, sf_dir):
        fr = lin_frame(spark, sf_dir)
        out = P.fit_impute_num(fr, option).transform(fr)
        return _out(out, ["l_quantity"])
    return q


for _o, _e in _IMPUTE.items():
    _impute_num_query(_o, _e)


def _random_fill_sql(table_cte: str, src: str, key_expr: str, col: str, keys: str, hit: str, cast: str = "") -> str:
    from ..operators.splits import sql_hkey
    draw = f"({sql_hkey(key_expr, 42)}) % (SELECT count(*) FROM lv)"
    val = f"(SELECT v FROM lv WHERE lv.code = {draw})"
    out = f"CASE WHEN {hit} THEN {val} ELSE {col} END"
    if cast:
        out = f"CAST({out} AS {cast})"
    return (f"WITH {table_cte}lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
            f"(SELECT DISTINCT {col} AS v FROM {src} WHERE {col} IS NOT NULL) AS d) "
            f"SELECT {keys}, {out} AS {col} FROM {src}")


@query("impute_num_random",
       _random_fill_sql(LIN_CTE + ", ", "lin", "l_orderkey * 8 + l_linenumber", "l_quantity", KEYS_SQL,
                        "l_quantity IS NULL"), group="phases")
def q_impute_num_random(spark, sf_dir):
    fr = lin_frame(spark, sf_dir)
    return _out(P.fit_impute_num(fr, "aleatorio").transform(fr), ["l_quantity"])


@query("drop_null_num", f"WITH {LIN_CTE} SELECT {KEYS_SQL}, {sql_sig('l_quantity')} AS l_quantity FROM lin "
       "WHERE l_quantity IS NOT NULL", group="phases")
def q_drop_null_num(spark, sf_dir):
    return _out(P.drop_null_num(lin_frame(spark, sf_dir)), ["l_quantity"])


# --------------------------------------------------------------- text impute
_MODE_STR = "(SELECT l_linestatus FROM lin WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, l_linestatus LIMIT 1)"


@query("impute_str_mode", f"WITH {LIN_CTE} SELECT {KEYS_SQL}, coalesce(l_linestatus, {_MODE_STR}) AS l_linestatus FROM lin",
       group="phases")
def q_impute_str_mode(spark, sf_dir):
    fr = lin_frame(spark, sf_dir)
    return _out(P.fit_impute_str(fr, "moda").transform(fr), ["l_linestatus"])


@query("impute_str_label", f"WITH {LIN_CTE} SELECT {KEYS_SQL}, coalesce(l_linestatus, 'DESCONOCIDO') AS l_linestatus FROM lin",
       group="phases")
def q_impute_str_label(spark, sf_dir):
    fr = lin_frame(spark, sf_dir)
    return _out(P.fit_impute_str(fr, "etiqueta_desconocido").transform(fr), ["l_linestatus"])


@query("impute_str_random",
       _random_fill_sql(LIN_CTE + ", ", "lin", "l_orderkey * 8 + l_linenumber", "l_linestatus", KEYS_SQL,
                        "l_linestatus IS NULL"), group="phases")
def q_impute_str_random(spark, sf_dir):
    fr = lin_frame(spark, sf_dir)
    return _out(P.fit_impute_str(fr, "aleatorio").transform(fr), ["l_linestatus"])


@query("drop_null_str", f"WITH {LIN_CTE} SELECT {KEYS_SQL}, l_linestatus FROM lin WHERE l_linestatus IS NOT NULL",
       group="phases")
def q_drop_null_str(spark, sf_dir):
    return _out(P.drop_null_str(lin_frame(spark, sf_dir)), ["l_linestatus"])


# ------------------------------------------------------------ binary encoding
@query("encode_binary_label",
       f"WITH {LIN_CTE} SELECT {KEYS_SQL}, CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lin) THEN 0.0 "
       "WHEN l_linestatus = (SELECT max(l_linestatus) FROM lin) THEN 1.0 END AS l_linestatus FROM lin",
       group="phases")
def q_encode_binary(spark, sf_dir):
    fr = lin_frame(spark, sf_dir)
    return _out(P.fit_binary_label(fr).transform(fr), ["l_linestatus"])


# ------------------------------------------------------- cardinality encoders
def part_frame(spark, sf_dir) -> Frame:
    pt = read_table(spark, sf_dir, "part")
    df = pt.select("p_partkey", "p_name", "p_brand", "p_type",
                   F.concat(F.lit("k"), (F.col("p_partkey") % 400).cast("string")).alias("p_mid"),
                   F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return Frame(df=df, num=("p_size", "p_retailprice"), cat=("p_name", "p_brand", "p_type", "p_mid"),
                 row_id="p_partkey", name="part")


PT_CTE = ("pt AS (SELECT p_partkey, p_name, p_brand, p_type, 'k' || CAST(p_partkey % 400 AS VARCHAR) AS p_mid, "
          "CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part)")
PT_TEXT = ["p_name", "p_brand", "p_type", "p_mid"]


def _ratio(c):
    return f"(SELECT count(DISTINCT {c}) * 1.0 / count(*) FROM pt)"


def _rank_sql(c):
    return (f"(SELECT CAST(r AS DOUBLE) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM "
            f"(SELECT DISTINCT {c} AS v FROM pt WHERE {c} IS NOT NULL) AS d) AS rk WHERE rk.v = pt.{c})")


def _text_long(df, cols):
    """(p_partkey, column_name, value string) for the given columns."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select("p_partkey", F.inline(F.array(*items)))


_LOW_LABEL_SQL = f"WITH {PT_CTE} " + " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS column_name, CASE WHEN {_ratio(c)} <= 0.05 THEN CAST({_rank_sql(c)} AS VARCHAR) "
    f"ELSE {c} END AS value FROM pt" for c in PT_TEXT)


@query("encode_low_card_label", _LOW_LABEL_SQL, group="phases")
def q_low_card_label(spark, sf_dir):
    fr = part_frame(spark, sf_dir)
    out = P.fit_low_card(fr, "label_encoding").transform(fr)
    return _text_long(out.df, PT_TEXT)


@query("encode_low_card_onehot",
       f"WITH {PT_CTE} " + " UNION ALL ".join(
           f"SELECT p_partkey, '{c}_' || l.v AS column_name, CAST(coalesce(pt.{c} = l.v, false) AS INTEGER) AS value "
           f"FROM pt CROSS JOIN (SELECT DISTINCT {c} AS v FROM pt WHERE {c} IS NOT NULL) AS l "
           f"WHERE {_ratio(c)} <= 0.05" for c in PT_TEXT),
       group="phases")
def q_low_card_onehot(spark, sf_dir):
    fr = part_frame(spark, sf_dir)
    out = P.fit_low_card(fr, "one_hot_encoding").transform(fr)
    new = [c for c in out.df.columns if c not in fr.df.columns]
    if not new:
        return spark.createDataFrame([], "p_partkey bigint, column_name string, value int")
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("int").alias("value")) for c in new]
    return out.df.select("p_partkey", F.inline(F.array(*items)))


_MID_SQL = f"WITH {PT_CTE} " + " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS column_name, {sql_sig('coalesce(f.freq, (SELECT min(freq) FROM f' + c + '))')} AS value "
    f"FROM pt LEFT JOIN (SELECT {c} AS v, count(*) * 1.0 / sum(count(*)) OVER () AS freq FROM pt WHERE {c} IS NOT NULL "
    f"GROUP BY 1) AS f ON f.v = pt.{c} WHERE {_ratio(c)} > 0.05 AND {_ratio(c)} < 0.90" for c in PT_TEXT)
_MID_SQL = _MID_SQL.replace(f"WITH {PT_CTE} ", f"WITH {PT_CTE}, " + ", ".join(
    f"f{c} AS (SELECT count(*) * 1.0 / sum(count(*)) OVER () AS freq FROM pt WHERE {c} IS NOT NULL GROUP BY {c})"
    for c in PT_TEXT) + " ", 1)


@query("encode_mid_card_freq", _MID_SQL, group="phases")
def q_mid_card_freq(spark, sf_dir):
    fr = part_frame(spark, sf_dir)
    f = P.fit_mid_card(fr, "frequency_encoding")
    out = f.transform(fr)
    cols = list(f.params)
    if not cols:
        return spark.createDataFrame([], "p_partkey bigint, column_name string, value double")
    items = [F.struct(F.lit(c).alias("column_name"), sig(F.col(c)).alias("value")) for c in cols]
    return out.df.select("p_partkey", F.inline(F.array(*items)))


@query("drop_mid_card", f"WITH {PT_CTE} " + " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS column_name, {c} AS value FROM pt WHERE {_ratio(c)} <= 0.05 OR {_ratio(c)} >= 0.90"
    for c in PT_TEXT), group="phases")
def q_drop_mid_card(spark, sf_dir):
    fr = part_frame(spark, sf_dir)
    out = P.fit_mid_card(fr, "eliminar_variable").transform(fr)
    return _text_long(out.df, list(out.cat))


@query("drop_high_card", "SELECT c_custkey, c_mktsegment FROM customer", group="phases")
def q_drop_high_card(spark, sf_dir):
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    fr = Frame(df=cu, num=(), cat=("c_name", "c_mktsegment"), row_id="c_custkey")
    out = P.fit_high_card(fr).transform(fr)
    return out.df


# ------------------------------------------------------------------ outliers
def events_value_frame(spark, sf_dir) -> Frame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("y"))
    return Frame(df=ev, num=("value",), cat=(), label="y", row_id="event_id", name="events")


_FENCE = ("(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)",
          "(SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)")
_OUT_STAT = {
    "media": "(SELECT round_even(avg(value), 2) FROM events)",
    "mediana": "(SELECT round_even(quantile_cont(value, 0.5), 2) FROM events)",
    "moda": "(SELECT value FROM events GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1)",
    "media_geometrica": "(SELECT round_even(exp(avg(ln(CASE WHEN value > 0 THEN value END))), 2) FROM events)",
}


def _outlier_query(option, stat):
    sql = (f"SELECT event_id, {sql_sig(f'CASE WHEN value < {_FENCE[0]} OR value > {_FENCE[1]} THEN {stat} ELSE value END')} "
           "AS value FROM events")

    @query(f"replace_outliers_{option}", sql, group="phases")
    def q(spark, sf_dir):
        fr = events_value_frame(spark, sf_dir)
        out = P.fit_outliers(fr, option).transform(fr)
        return out.df.select("event_id", sig(F.col("value")).alias("value"))
    return q


for _o, _s in _OUT_STAT.items():
    _outlier_query(_o, _s)


@query("replace_outliers_random",
       _random_fill_sql("", "events", "event_id", "value", "event_id",
                        f"(value < {_FENCE[0]} OR value > {_FENCE[1]})"), group="phases")
def q_outliers_random(spark, sf_dir):
    fr = events_value_frame(spark, sf_dir)
    out = P.fit_outliers(fr, "aleatorio").transform(fr)
    return out.df.select("event_id", sig(F.col("value")).alias("value"))


@query("drop_outliers", f"SELECT event_id, {sql_sig('value')} AS value FROM events "
       f"WHERE value >= {_FENCE[0]} AND value <= {_FENCE[1]}", group="phases")
def q_drop_outliers(spark, sf_dir):
    fr = events_value_frame(spark, sf_dir)
    out = P.fit_outliers(fr, "eliminar").transform(fr)
    return out.df.select("event_id", sig(F.col("value")).alias("value"))


# -------------------------------------------------------------------- scalers
def _scale_sql(center, scale):
    parts = []
    for c in LI_NUM:
        ce, sc = center(c), scale(c)
        parts.append(f"{sql_sig(f'CAST(CAST(round_even(({c} - ({ce})) / ({sc}), 3) AS FLOAT) AS DOUBLE)')} AS {c}")
    return f"SELECT {KEYS_SQL}, " + ", ".join(parts) + " FROM lineitem"


def _nz(e):
    return f"(CASE WHEN ({e}) = 0 THEN 1.0 ELSE ({e}) END)"


_SCALERS = {
    "min_max": (lambda c: f"(SELECT min({c}) FROM lineitem)",
                lambda c: _nz(f"(SELECT max({c}) - min({c}) FROM lineitem)")),
    "standard_scaler": (lambda c: f"(SELECT avg({c}) FROM lineitem)",
                        lambda c: _nz(f"(SELECT stddev_pop({c}) FROM lineitem)")),
    "robust_scaler": (lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)",
                      lambda c: _nz(f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)")),
    "max_abs_scaler": (lambda c: "0.0", lambda c: _nz(f"(SELECT max(abs({c})) FROM lineitem)")),
}


def li_num_frame(spark, sf_dir) -> Frame:
    li = read_table(spark, sf_dir, "lineitem").select(*KEY, *LI_NUM, F.col("l_returnflag").alias("y"))
    return Frame(df=li, num=LI_NUM, cat=(), label="y", name="lineitem")


def _scale_query(option):
    c, s = _SCALERS[option]

    @query(f"scale_{option}", _scale_sql(c, s), group="phases")
    def q(spark, sf_dir):
        fr = li_num_frame(spark, sf_dir)
        out = P.fit_scale(fr, option).transform(fr)
        return out.df.select(*KEY, *[sig(F.col(x).cast("double")).alias(x) for x in LI_NUM])
    return q


for _o in _SCALERS:
    _scale_query(_o)


# ----------------------------------------------------------------- normalisers
def cust_frame(spark, sf_dir) -> Frame:
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("y"))
    return Frame(df=cu, num=("c_acctbal",), cat=(), label="y", row_id="c_custkey", name="customer")


_SHIFT = "(SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1e-3 ELSE 0.0 END FROM customer)"
_NORMS = {
    "z_score": "(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)",
    "sqrt": f"sqrt(c_acctbal + {_SHIFT})",
    "ln": f"ln(1 + c_acctbal + {_SHIFT})",
    "inverso": "CASE WHEN c_acctbal = 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0 / c_acctbal END",
    "cuadrado": "c_acctbal * c_acctbal",
}


def _norm_query(option, expr):
    @query(f"normalise_{option}", f"SELECT c_custkey, {sql_sig(expr)} AS c_acctbal FROM customer", group="phases")
    def q(spark, sf_dir):
        fr = cust_frame(spark, sf_dir)
        out = P.fit_normalise(fr, option).transform(fr)
        return out.df.select("c_custkey", sig(F.col("c_acctbal")).alias("c_acctbal"))
    return q


for _o, _e in _NORMS.items():
    _norm_query(_o, _e)


@query("normalise_box_cox", group="phases")
def q_norm_boxcox(spark, sf_dir):
    """lambda by maximum likelihood (rows-only check), then the apply."""
    fr = cust_frame(spark, sf_dir)
    f = P.fit_normalise(fr, "box_cox")
    out = f.transform(fr)
    return out.df.select("c_custkey", sig(F.col("c_acctbal")).alias("c_acctbal"),
                         F.lit(f.params["lambda"]["c_acctbal"]).alias("lambda"))


@query("normalise_box_cox_fixed",
       f"SELECT c_custkey, {sql_sig(f'(power(c_acctbal + {_SHIFT}, 0.5) - 1.0) / 0.5')} AS c_acctbal FROM customer",
       group="phases")
def q_norm_boxcox_fixed(spark, sf_dir):
    """Box-Cox apply with lambda fixed at 0.5 (shift rule as sqrt/ln)."""
    fr = cust_frame(spark, sf_dir)
    out = P.fit_normalise(fr, "box_cox", lambdas={"c_acctbal": 0.5}).transform(fr)
    return out.df.select("c_custkey", sig(F.col("c_acctbal")).alias("c_acctbal"))


# ------------------------------------------------------- derived / selections
@query("derive_columns",
       f"SELECT {KEYS_SQL}, {sql_sig('l_extendedprice / l_quantity')} AS unit_price, "
       f"{sql_sig('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge FROM lineitem",
       group="phases")
def q_derive(spark, sf_dir):
    fr = li_num_frame(spark, sf_dir)
    out = P.derive_columns(fr, {
        "unit_price": "l_extendedprice / l_quantity",
        "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
        "broken": "no_such_column + 1",
    })
    return out.df.select(*KEY, sig(F.col("unit_price")).alias("unit_price"), sig(F.col("charge")).alias("charge"))


@query("select_columns", f"SELECT {KEYS_SQL}, l_discount, l_tax FROM lineitem", group="phases")
def q_select(spark, sf_dir):
    fr = li_num_frame(spark, sf_dir)
    out = P.select_columns(fr, ["l_discount", "l_tax", "not_a_column"])
    return out.df.select(*KEY, *out.attrs)


@query("select_random", group="phases")
def q_select_random(spark, sf_dir):
    fr = li_num_frame(spark, sf_dir)
    out = P.select_random(fr, seed=42)
    return out.df.select(*KEY, *out.attrs)


def _mi_sql():
    cols = list(LI_NUM) + ["l_linestatus"]
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS attr, {sql_sig('sum(cnt / n * ln(cnt * n / (nx * ny)))')} AS mi FROM ("
            f"SELECT cnt, sum(cnt) OVER () AS n, sum(cnt) OVER (PARTITION BY v) AS nx, sum(cnt) OVER (PARTITION BY y) AS ny "
            f"FROM (SELECT CAST({c} AS VARCHAR) AS v, l_returnflag AS y, CAST(count(*) AS DOUBLE) AS cnt FROM lineitem "
            f"GROUP BY 1, 2) AS a) AS b")
    return " UNION ALL ".join(parts)


@query("mutual_info_scores", _mi_sql(), group="phases")
def q_mutual_info(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(*LI_NUM, "l_linestatus", F.col("l_returnflag").alias("y"))
    fr = Frame(df=li, num=LI_NUM, cat=("l_linestatus",), label="y")
    return P.mutual_info_scores(fr).select("attr", sig(F.col("mi")).alias("mi"))


@query("mutual_info_numeric", group="phases")
def q_mutual_info_numeric(spark, sf_dir):
    """Scores of the other numeric columns with the price as numeric target."""
    from ..operators.nnmi import mutual_info_numeric
    cols = [c for c in LI_NUM if c != "l_extendedprice"]
    # order and line number repeat in this table: rows are numbered instead
    li = read_table(spark, sf_dir, "lineitem").select(*LI_NUM)
    return mutual_info_numeric(Frame(df=li, num=tuple(cols), label="l_extendedprice"))


# ---------------------------------------------------------------- duplicates
@query("dedup_rows",
       f"SELECT {KEYS_SQL}, l_quantity, l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_quantity, "
       f"l_linestatus ORDER BY {KEYS_SQL}) AS rn FROM lineitem) AS t WHERE rn = 1",
       group="phases")
def q_dedup(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(*KEY, "l_quantity", "l_linestatus", F.col("l_returnflag").alias("y"))
    fr = Frame(df=li, num=("l_quantity",), cat=("l_linestatus",), label="y")
    out = P.dedup_rows(fr, order_by=KEY)
    return out.df.select(*KEY, "l_quantity", "l_linestatus")
