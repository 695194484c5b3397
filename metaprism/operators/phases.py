"""Preprocessing phases (P1-P38): fit on train -> parameters, apply anywhere.

Every phase follows one contract:

* ``fit(fr)`` runs at most a couple of small aggregate actions over the train
  Frame and returns a ``Fitted`` holding plain parameters (JSON-able dict).
* ``Fitted.transform(fr)`` only adds column expressions, filters or joins with
  small fitted tables - no action - so applying to validation data, or to a
  streaming DataFrame, is the same plan.

Columns: numeric phases act on ``fr.num``, text phases on ``fr.cat``; keys and
the label pass through.  Rounding follows the reference: half-even to 2
decimals for imputation parameters, 3 decimals + float32 for scalers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, NUMERIC_TYPES, NotComputable
from ..session import ensure_checkpoint_dir
from ..functions.orderstats import modes, quantiles, value_counts
from ..functions.ranking import sorted_levels, level_codes

UNKNOWN_LABEL = "DESCONOCIDO"  # fixed value: fill text of the reference's label imputation
MISSING_TOKENS = ("", "na", "n/a", "null", "none")  # fixed values: texts read as missing
LOW_CARD, HIGH_CARD = 0.05, 0.90  # fixed values: cardinality ratio bounds
MAX_ONEHOT_LEVELS = 1000


def _d(c: str) -> Column:
    return F.col(c).cast("double")


@dataclass
class Fitted:
    phase: str
    option: str | None
    params: dict[str, Any] = field(default_factory=dict)
    apply: Callable[[Frame, dict], Frame] | None = None

    def transform(self, fr: Frame) -> Frame:
        if self.apply is None:
            return fr
        return self.apply(fr, self.params)


def _null_cols(fr: Frame, cols) -> list[str]:
    """Columns that hold at least one null (one aggregate)."""
    cols = list(cols)
    if not cols:
        return []
    r = fr.df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"z{i}"] == 1]


# ------------------------------------------------------------- P1 duplicates
def dedup_rows(fr: Frame, order_by: list[str] | None = None) -> Frame:
    """Keep the first row (by ``order_by``, default the row key) of each
    distinct feature tuple.

    Written as an aggregate (``min`` of a struct led by the order key) rather
    than a window: partial aggregation collapses a hot tuple map-side, so a
    tuple holding a third of the rows costs no more than any other.
    """
    order_by = list(order_by or ([fr.row_id] if fr.row_id else []))
    if not order_by:
        raise ValueError("dedup needs a row order key")
    feats = list(fr.attrs)
    rest = [c for c in fr.df.columns if c not in feats and c not in order_by]
    first = F.min(F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in rest])).alias("_first")
    out = (fr.df.groupBy(*[F.col(c) for c in feats]).agg(first)
           .select(*[F.col(f"_first.{c}").alias(c) for c in order_by], *feats,
                   *[F.col(f"_first.{c}").alias(c) for c in rest]))
    return fr.with_df(out.select(*fr.df.columns))


# ---------------------------------------------------------------- P2 binary
def fit_binary_label(fr: Frame) -> Fitted:
    """Text columns with exactly two non-null values -> 0.0 / 1.0 by order."""
    cols = list(fr.cat)
    mm = fr.df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first() if cols else {}
    cand = [(i, c) for i, c in enumerate(cols) if mm[f"lo{i}"] is not None and mm[f"lo{i}"] != mm[f"hi{i}"]]
    params = {}
    if cand:
        r = fr.df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c) != mm[f"lo{i}"]) & (F.col(c) != mm[f"hi{i}"]))
                        .alias(f"o{i}") for i, c in cand]).first()
        params = {c: [mm[f"lo{i}"], mm[f"hi{i}"]] for i, c in cand if r[f"o{i}"] == 0}

    def apply(fr: Frame, p: dict) -> Frame:
        df = fr.df
        for c, (lo, hi) in p.items():
            df = df.withColumn(c, F.when(F.col(c) == lo, 0.0).when(F.col(c) == hi, 1.0).otherwise(F.lit(None).cast("double")))
        moved = [c for c in fr.cat if c in p]
        return fr.with_df(df, num=fr.num + tuple(moved), cat=tuple(c for c in fr.cat if c not in p))
    return Fitted("binary", "label_encoding", params, apply)


# ------------------------------------------------------ P3-P7 numeric impute
def fit_impute_num(fr: Frame, option: str, seed: int = 42) -> Fitted:
    cols = _null_cols(fr, fr.num)
    params: dict[str, Any] = {}
    if cols and option in ("media", "mediana", "media_geometrica", "moda"):
        params = _stat_params(fr, option, cols)
    elif cols and option == "aleatorio":
        return _fit_random_fill(fr, cols, seed, "impute_num")
    elif option not in ("media", "mediana", "media_geometrica", "moda", "aleatorio"):
        raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        fill = {c: float(v) for c, v in p.items() if v is not None}
        return fr.with_df(fr.df.na.fill(fill) if fill else fr.df)
    return Fitted("impute_num", option, params, apply)


#: Distinct values of a column that are sent to all tasks.
BROADCAST_LEVELS = 10_000


def _fit_random_fill(fr: Frame, cols: list[str], seed: int, phase: str, where=None) -> Fitted:
    """Fill each null (or each ``where`` cell) with a distinct train value
    picked by a portable hash of (row key, seed + 7919 * column position).
    The distinct-value table is ranked distributedly and joined on the drawn
    rank - no value list on the driver, no per-row Python.  Up to
    ``BROADCAST_LEVELS`` values go to the rows; with more, cells that are kept
    have keys of their own, which no value has, so that they do not meet.
    """
    if fr.row_id is None:
        raise ValueError("random fill needs a row key")
    tables = {}
    for c in cols:
        lv = sorted_levels(fr.df.select(F.col(c).alias("value")).where(F.col("value").isNotNull()))
        tables[c] = lv  # (value, code) plus a count via lv.count()
    sizes = {c: t.count() for c, t in tables.items()}
    params = {"cols": cols, "seed": seed, "sizes": sizes}
    params["_tables"] = tables

    def apply(fr: Frame, p: dict) -> Frame:
        df = fr.df
        from .splits import hkey
        for j, c in enumerate(p["cols"]):
            k = p["sizes"][c]
            if k == 0:
                continue
            hit = F.col(c).isNull() if where is None else where(c)
            draw = hkey(F.col(fr.row_id), p["seed"] + 7919 * j) % F.lit(k)
            lv = p["_tables"][c].select(F.col("code").alias(f"_d_{c}"), F.col("value").alias(f"_v_{c}"))
            kept = -1 - F.pmod(F.xxhash64(fr.row_id), F.lit(1 << 40))
            df = (df.withColumn(f"_d_{c}", F.when(hit, draw).otherwise(kept))
                  .join(F.broadcast(lv) if k <= BROADCAST_LEVELS else lv, f"_d_{c}", "left")
                  .withColumn(c, F.when(F.col(f"_d_{c}") >= 0, F.col(f"_v_{c}").cast(df.schema[c].dataType))
                              .otherwise(F.col(c)))
                  .drop(f"_d_{c}", f"_v_{c}"))
        return fr.with_df(df.select(*fr.df.columns))
    return Fitted(phase, "aleatorio", params, apply)


def drop_null_num(fr: Frame) -> Frame:
    return fr.with_df(fr.df.na.drop(subset=list(fr.num))) if fr.num else fr


# --------------------------------------------------------- P9-P12 text impute
def fit_impute_str(fr: Frame, option: str, seed: int = 42) -> Fitted:
    cols = _null_cols(fr, fr.cat)
    params: dict[str, Any] = {}
    if option == "moda" and cols:
        params = {c: "" if v is None else v for c, v in modes(fr.df, {c: F.col(c).cast("string") for c in cols}).items()}
    elif option == "etiqueta_desconocido":
        params = {c: UNKNOWN_LABEL for c in cols}
    elif option == "aleatorio" and cols:
        return _fit_random_fill(fr, cols, seed, "impute_str")
    elif option not in ("moda", "etiqueta_desconocido", "aleatorio"):
        raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        return fr.with_df(fr.df.na.fill(p) if p else fr.df)
    return Fitted("impute_str", option, params, apply)


def drop_null_str(fr: Frame) -> Frame:
    return fr.with_df(fr.df.na.drop(subset=list(fr.cat))) if fr.cat else fr


# ----------------------------------------------- P13-P17 cardinality encoders
def cardinality_ratios(fr: Frame) -> dict[str, float]:
    """distinct non-null values / rows for every text column (one aggregate)."""
    cols = list(fr.cat)
    if not cols:
        return {}
    r = fr.df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(cols)]).first()
    n = r["n"]
    return {c: (r[f"u{i}"] / n if n else 0.0) for i, c in enumerate(cols)}


def fit_low_card(fr: Frame, option: str) -> Fitted:
    ratios = cardinality_ratios(fr)
    cols = [c for c, v in ratios.items() if v <= LOW_CARD]
    params: dict[str, Any] = {}
    if option == "one_hot_encoding":
        params = all_level_values(fr, cols, MAX_ONEHOT_LEVELS)
    elif option == "label_encoding":
        for c in cols:
            params[c] = sorted_levels(fr.df.select(F.col(c).alias("value")).where(F.col("value").isNotNull()))
    else:
        raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        df, num, cat = fr.df, list(fr.num), list(fr.cat)
        for c, v in p.items():
            if option == "label_encoding":
                df = level_codes(df, c, v).withColumn(c, F.col(c).cast("double"))
                num.append(c)
            else:
                new = [F.coalesce((F.col(c) == F.lit(val)).cast("int"), F.lit(0)).alias(f"{c}_{val}") for val in v]
                keep = [x for x in df.columns if x != c]
                df = df.select(*keep, *new)
                num += [f"{c}_{val}" for val in v]
            cat.remove(c)
        return fr.with_df(df, num=tuple(num), cat=tuple(cat))
    return Fitted("low_card", option, params, apply)


def all_level_values(fr: Frame, cols: list, limit: int) -> dict:
    """Sorted level list of every column, for schema-shaping phases (one
    column per level), from one pass over all columns.

    The level counts are checked first; beyond ``limit`` the phase refuses, as
    a column per value would not be a sane schema.
    """
    if not cols:
        return {}
    ensure_checkpoint_dir(fr.spark)
    levels = value_counts(fr.df, {c: F.col(c).cast("string") for c in cols}).select("attr", "value").checkpoint(eager=True)
    for r in levels.groupBy("attr").count().collect():  # one row a column
        if r["count"] > limit:
            raise NotComputable(f"{r['count']} levels of {cols[r['attr']]} exceed the one-hot limit {limit}")
    out: dict = {c: [] for c in cols}
    for r in levels.orderBy("attr", "value").collect():
        out[cols[r["attr"]]].append(r["value"])
    return out


def fit_mid_card(fr: Frame, option: str) -> Fitted:
    ratios = cardinality_ratios(fr)
    cols = [c for c, v in ratios.items() if LOW_CARD < v < HIGH_CARD]
    params: dict[str, Any] = {}
    if option == "frequency_encoding":
        for c in cols:
            vc = (fr.df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value"))
                  .agg(F.count(F.lit(1)).alias("cnt")))
            tot = vc.agg(F.sum("cnt").alias("t"), F.min("cnt").alias("m")).first()
            params[c] = {"freq": vc.select("value", (F.col("cnt") / F.lit(float(tot["t"]))).alias("freq")),
                         "min": tot["m"] / tot["t"]}
    elif option == "eliminar_variable":
        params = {c: True for c in cols}
    else:
        raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        df, num, cat = fr.df, list(fr.num), list(fr.cat)
        for c, v in p.items():
            cat.remove(c)
            if option == "eliminar_variable":
                df = df.drop(c)
                continue
            fq = v["freq"].select(F.col("value").alias(f"_k_{c}"), F.col("freq").alias(f"_f_{c}"))
            # the frequency table has one row per train value; Spark picks
            # broadcast or shuffle join from its size (AQE), no driver copy
            df = (df.join(fq, df[c] == fq[f"_k_{c}"], "left")
                  .withColumn(c, F.coalesce(F.col(f"_f_{c}"), F.lit(v["min"])).cast("double"))
                  .drop(f"_k_{c}", f"_f_{c}"))
            num.append(c)
        return fr.with_df(df.select(*[x for x in fr.df.columns if x in df.columns]), num=tuple(num), cat=tuple(cat))
    return Fitted("mid_card", option, params, apply)


def fit_high_card(fr: Frame) -> Fitted:
    ratios = cardinality_ratios(fr)
    cols = [c for c, v in ratios.items() if v >= HIGH_CARD]

    def apply(fr: Frame, p: dict) -> Frame:
        drop = [c for c in p["cols"] if c in fr.df.columns]
        return fr.with_df(fr.df.drop(*drop), cat=tuple(c for c in fr.cat if c not in drop))
    return Fitted("high_card", "eliminar_columna", {"cols": cols}, apply)


# ------------------------------------------------------------ P18-P20 outliers
def _fences(fr: Frame, cols, whis=1.5) -> dict[str, tuple[float, float]]:
    if not cols:
        return {}
    r = quantiles(fr.df, {f"q{i}": _d(c) for i, c in enumerate(cols)}, [0.25, 0.75])
    out = {}
    for i, c in enumerate(cols):
        q = r[f"q{i}"]
        if q is None:
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - whis * iqr, q[1] + whis * iqr)
    return out


def fit_outliers(fr: Frame, option: str, only_null_columns: bool = False, seed: int = 42) -> Fitted:
    """Replace values outside the 1.5 IQR fences by a fitted statistic.

    ``only_null_columns=True`` keeps the reference rule (only columns holding
    nulls at fit time get parameters, and fences come from the frame being
    transformed); the default fits every numeric column on train.
    """
    cols = _null_cols(fr, fr.num) if only_null_columns else list(fr.num)
    stat = {"media": "media", "mediana": "mediana", "moda": "moda", "media_geometrica": "media_geometrica"}
    if option == "aleatorio":
        fences = _fences(fr, cols)
        inner = _fit_random_fill(fr, cols, seed, "outliers",
                                 where=lambda c: (_d(c) < fences[c][0]) | (_d(c) > fences[c][1]) if c in fences else F.lit(False))
        inner.params["fences"] = fences
        return inner
    if option == "eliminar":
        fences = _fences(fr, cols)

        def drop(fr: Frame, p: dict) -> Frame:
            if only_null_columns:
                return fr.with_df(fr.df.na.drop(subset=list(fr.num)))
            cond = F.lit(True)
            for c, (lo, hi) in p["fences"].items():
                cond = cond & (_d(c).isNull() | ((_d(c) >= lo) & (_d(c) <= hi)))
            return fr.with_df(fr.df.where(cond))
        return Fitted("outliers", option, {"fences": fences}, drop)
    if option not in stat:
        raise ValueError(option)
    sub = Frame(df=fr.df, num=tuple(cols), cat=(), label=fr.label, row_id=fr.row_id)
    vals = _stat_params(sub, option, cols)
    fences = None if only_null_columns else _fences(fr, cols)

    def apply(fr: Frame, p: dict) -> Frame:
        fz = p["fences"] if p["fences"] is not None else _fences(fr, list(p["values"]))
        df = fr.df
        for c, v in p["values"].items():
            if v is None or c not in fz:
                continue
            lo, hi = fz[c]
            df = df.withColumn(c, F.when((_d(c) < lo) | (_d(c) > hi), F.lit(float(v)).cast(df.schema[c].dataType))
                               .otherwise(F.col(c)))
        return fr.with_df(df)
    return Fitted("outliers", option, {"values": vals, "fences": fences}, apply)


def _stat_params(fr: Frame, option: str, cols) -> dict[str, float | None]:
    if not cols:
        return {}
    xs = {c: _d(c) for c in cols}
    if option == "moda":
        return modes(fr.df, xs)
    if option == "mediana":
        middle = quantiles(fr.df, xs, [0.5])
        half_even = fr.df.sparkSession.range(1).select(*[F.bround(F.lit(None if q is None else q[0]).cast("double"), 2) for q in middle.values()])
        return dict(zip(middle, half_even.first()))
    if option == "media":
        aggs = [F.bround(F.avg(x), 2) for x in xs.values()]
    else:
        aggs = [F.bround(F.exp(F.avg(F.ln(F.when(x > 0, x)))), 2) for x in xs.values()]
    return dict(zip(cols, fr.df.agg(*aggs).first()))


# --------------------------------------------------------------- P21-P24 scale
def fit_scale(fr: Frame, option: str, round_digits: int | None = 3, as_float: bool = True) -> Fitted:
    cols = list(fr.num)
    params: dict[str, Any] = {}
    if cols:
        if option == "min_max":
            r = fr.df.agg(*[F.min(_d(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                          *[F.max(_d(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
            params = {c: (r[f"a{i}"], (r[f"b{i}"] - r[f"a{i}"]) or 1.0) for i, c in enumerate(cols)}
        elif option == "standard_scaler":
            r = fr.df.agg(*[F.avg(_d(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(_d(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
            params = {c: (r[f"a{i}"], r[f"b{i}"] or 1.0) for i, c in enumerate(cols)}
        elif option == "robust_scaler":
            r = quantiles(fr.df, {c: _d(c) for c in cols}, [0.25, 0.5, 0.75])
            params = {c: (q[1], (q[2] - q[0]) or 1.0) for c, q in r.items() if q}
        elif option == "max_abs_scaler":
            r = fr.df.agg(*[F.max(F.abs(_d(c))).alias(f"b{i}") for i, c in enumerate(cols)]).first()
            params = {c: (0.0, r[f"b{i}"] or 1.0) for i, c in enumerate(cols)}
        else:
            raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        df = fr.df
        for c, (center, scale) in p.items():
            v = (_d(c) - F.lit(center)) / F.lit(scale)
            if round_digits is not None:
                v = F.bround(v, round_digits)
            df = df.withColumn(c, v.cast("float") if as_float else v)
        return fr.with_df(df)
    return Fitted("scale", option, params, apply)


def standardise_matrix(fr: Frame) -> Fitted:
    """Mean / population-sd standardiser without rounding."""
    return fit_scale(fr, "standard_scaler", round_digits=None, as_float=False)


# ------------------------------------------------------------ P25-P30 normalise
def _shifts(fr: Frame, cols) -> dict[str, float]:
    """Shift making a column positive: |min| + 1e-3 when min <= 0, else 0."""
    if not cols:
        return {}
    r = fr.df.agg(*[F.min(_d(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: (abs(r[f"m{i}"]) + 1e-3 if r[f"m{i}"] is not None and r[f"m{i}"] <= 0 else 0.0)
            for i, c in enumerate(cols)}


def fit_normalise(fr: Frame, option: str, lambdas: dict | None = None) -> Fitted:
    cols = list(fr.num)
    params: dict[str, Any] = {}
    if option == "z_score":
        r = fr.df.agg(*[F.avg(_d(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                      *[F.stddev_pop(_d(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first() if cols else {}
        params = {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}
    elif option in ("sqrt", "ln", "box_cox"):
        params = {"shift": _shifts(fr, cols)}
        if option == "box_cox":
            params["lambda"] = lambdas or boxcox_lambdas(fr, cols, params["shift"])
    elif option not in ("inverso", "cuadrado"):
        raise ValueError(option)

    def apply(fr: Frame, p: dict) -> Frame:
        df = fr.df
        for c in cols:
            x = _d(c)
            if option == "z_score":
                mu, sd = p[c]
                v = F.try_divide(x - F.lit(mu), F.lit(sd))
            elif option == "sqrt":
                v = F.sqrt(x + F.lit(p["shift"][c]))
            elif option == "ln":
                v = F.log1p(x + F.lit(p["shift"][c]))
            elif option == "box_cox":
                lam = p["lambda"][c]
                xs = x + F.lit(p["shift"][c])
                v = F.ln(xs) if abs(lam) < 1e-12 else (F.pow(xs, F.lit(lam)) - 1.0) / F.lit(lam)
            elif option == "inverso":
                v = F.when(x == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / x)
            else:
                v = x * x
            df = df.withColumn(c, v)
        return fr.with_df(df)
    return Fitted("normalise", option, params, apply)


def boxcox_lambdas(fr: Frame, cols, shifts, grid=(-2.0, 2.0), steps: int = 41, rounds: int = 4) -> dict:
    """Maximum-likelihood Box-Cox lambda per column by grid refinement.

    Each round evaluates the profile log-likelihood
    ``(lam - 1) * sum(ln x) - n/2 * ln(var_pop(y_lam))`` for all columns and
    all grid points in ONE aggregate, then narrows the grid around the best
    point.  ``rounds`` passes over the data in total.
    """
    out = {}
    lo = {c: grid[0] for c in cols}
    hi = {c: grid[1] for c in cols}
    for _ in range(rounds):
        aggs, pts = [], {}
        for i, c in enumerate(cols):
            xs = _d(c) + F.lit(shifts[c])
            pts[c] = [lo[c] + (hi[c] - lo[c]) * k / (steps - 1) for k in range(steps)]
            aggs.append(F.sum(F.ln(xs)).alias(f"sl{i}"))
            aggs.append(F.count(xs).alias(f"n{i}"))
            for k, lam in enumerate(pts[c]):
                y = F.ln(xs) if abs(lam) < 1e-12 else (F.pow(xs, F.lit(lam)) - 1.0) / F.lit(lam)
                aggs.append(F.var_pop(y).alias(f"v{i}_{k}"))
        r = fr.df.agg(*aggs).first()
        for i, c in enumerate(cols):
            best, bk = -math.inf, 0
            for k, lam in enumerate(pts[c]):
                v = r[f"v{i}_{k}"]
                if v is None or v <= 0:
                    continue
                ll = (lam - 1.0) * r[f"sl{i}"] - r[f"n{i}"] / 2.0 * math.log(v)
                if ll > best:
                    best, bk = ll, k
            step = (hi[c] - lo[c]) / (steps - 1)
            out[c] = pts[c][bk]
            lo[c], hi[c] = out[c] - step, out[c] + step
    return out


# --------------------------------------------------------- P31-P33 columns
def derive_columns(fr: Frame, exprs: dict[str, str]) -> Frame:
    """Add columns from name -> SQL expression; invalid expressions are skipped
    (checked by analysis only, no job)."""
    df, num = fr.df, list(fr.num)
    for name, text in exprs.items():
        try:
            cand = df.withColumn(name, F.expr(text))
            cand.schema  # analysis only
        except Exception:  # noqa: BLE001 - a failing expression is skipped
            continue
        df = cand
        if isinstance(df.schema[name].dataType, NUMERIC_TYPES) and name not in num:
            num.append(name)
    return fr.with_df(df, num=tuple(num))


def select_columns(fr: Frame, cols: list[str]) -> Frame:
    keep = [c for c in cols if c in fr.attrs]
    others = [c for c in fr.df.columns if c not in fr.attrs]
    return fr.with_df(fr.df.select(*others, *keep), num=tuple(c for c in fr.num if c in keep),
                      cat=tuple(c for c in fr.cat if c in keep))


def select_random(fr: Frame, seed: int = 42) -> Frame:
    import random
    rng = random.Random(seed)
    attrs = list(fr.attrs)
    k = rng.randint(1, len(attrs))
    return select_columns(fr, sorted(rng.sample(attrs, k), key=attrs.index))


# ----------------------------------------------------------- P34 mutual info
def mutual_info_scores(fr: Frame) -> DataFrame:
    """(attr, mi) in nats, every column treated as discrete (classification)."""
    from . import contingency as K
    cols = list(fr.attrs)
    sub = Frame(df=fr.df, num=(), cat=tuple(cols), label=fr.label)
    ct = K.attr_class_counts(sub, cols)
    n_attr = ct.groupBy("attr").agg(F.sum("cnt").alias("n"))
    px = ct.groupBy("attr", "value").agg(F.sum("cnt").alias("nx"))
    py = ct.groupBy("attr", "y").agg(F.sum("cnt").alias("ny"))
    j = ct.join(n_attr, "attr").join(px, ["attr", "value"]).join(py, ["attr", "y"])
    term = (F.col("cnt") / F.col("n")) * F.ln(F.col("cnt") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("attr").agg(F.sum(term).alias("mi"))


def select_mutual_info(fr: Frame, share: float, task: str = "clasificacion") -> Frame:
    """Columns of at least ``share`` of the best score; with a numeric target
    (``regresion``) the numeric columns by nearest neighbours, text columns go."""
    if task == "regresion":
        from .nnmi import mutual_info_numeric
        scores = {r["attr"]: r["mi"] for r in mutual_info_numeric(fr).collect() if r["mi"] == r["mi"]}  # one row per column
    else:
        scores = {r["attr"]: r["mi"] for r in mutual_info_scores(fr).collect()}  # one row per column
    top = max(scores.values(), default=0.0)
    keep = [c for c in fr.attrs if top > 0 and scores.get(c, 0.0) >= share * top]
    return select_columns(fr, keep)


def fit_select_mutual_info(fr: Frame, share: float, task: str = "clasificacion") -> Fitted:
    """P34 as a fitted phase: columns chosen on train, applied anywhere."""
    keep = list(select_mutual_info(fr, share, task).attrs)
    return Fitted("select", f"mutual_info_{int(share * 100)}", {"keep": keep},
                  lambda f, p: select_columns(f, p["keep"]))


def fit_select_by_forest(fr: Frame, task: str = "clasificacion", trees: int = 100, seed: int = 42) -> Fitted:
    """Random-forest importances (100 trees), keep columns with
    importance >= mean importance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    cols = list(fr.num)
    data = VectorAssembler(inputCols=cols, outputCol="_f", handleInvalid="keep").transform(fr.df)
    if task == "regresion":
        model = RandomForestRegressor(numTrees=trees, seed=seed, featuresCol="_f", labelCol=fr.label).fit(data)
    else:
        from ..frame import collect_bounded
        classes = sorted(r[0] for r in collect_bounded(fr.df.select(fr.y()).distinct(), "classes"))
        idx = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        model = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="_f", labelCol="_l").fit(
            data.withColumn("_l", idx[fr.y()]))
    imp = model.featureImportances.toArray()
    keep = [c for c, v in zip(cols, imp) if v >= imp.mean()]
    return Fitted("select", "select_from_model", {"keep": keep}, lambda f, p: select_columns(f, p["keep"]))


def fit_pca(fr: Frame, share: float) -> Fitted:
    """Principal components reaching ``share`` of the variance, fitted on
    train (centred, not scaled), applied anywhere; output columns PC1..PCk."""
    from pyspark.ml.feature import VectorAssembler, StandardScaler, PCA
    from pyspark.ml.functions import vector_to_array
    cols = list(fr.num)
    va = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep")
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(va.transform(fr.df))
    pca = PCA(k=len(cols), inputCol="_c", outputCol="_pc").fit(sc.transform(va.transform(fr.df)))
    ev = pca.explainedVariance.toArray()
    cum, k = 0.0, 0
    for v in ev:
        k += 1
        cum += v
        if cum >= share - 1e-12:
            break
    names = [f"PC{i + 1}" for i in range(k)]

    def apply(f: Frame, p: dict) -> Frame:
        keep = [c for c in f.df.columns if c not in cols]
        out = pca.transform(sc.transform(va.transform(f.df)))
        arr = vector_to_array(F.col("_pc"))
        out = out.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])
        return f.with_df(out, num=tuple(names), cat=tuple(c for c in f.cat if c in keep))
    return Fitted("select", f"pca_{int(share * 100)}", {"k": k, "explained": ev.tolist()}, apply)
