"""Bootstrap replicates of class and pair moments in one pass over the rows.

Every row has one array of Poisson(1) weights, drawn from its key; a task keeps,
per class, one vector of weighted sums a replicate (matrix products of weights
and powers) and emits it once.  No row is repeated, whatever the number of
replicates.  Replicate 0 has weight 1 everywhere: the data themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, NotComputable, collect_bounded, keyed
from . import gram
from . import moments as M
from .splits import hkey

#: Numbers of one class that a task emits, and of all classes that the driver takes.
MAX_CLASS_CELLS = 16_000_000
MAX_DRIVER_CELLS = 64_000_000
STATE = T.StructType([T.StructField("cls", T.StringType()), T.StructField("sums", T.BinaryType()),
                      T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])
_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(16)])
#: Sums kept a column: values there, powers of deviations, logarithms of positive values and their count, reciprocals.
PER_COLUMN = ("n", "s1", "s2", "s3", "s4", "ln", "pos", "inv")


def replicate_weights(draws: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates + 1) weights of rows with the given 60-bit draws."""
    with np.errstate(over="ignore"):
        x = draws.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53
    return np.hstack([np.ones((len(draws), 1)), np.searchsorted(_CDF, u, side="right").astype(float)])


@dataclass
class Resampled:
    """Per class the weighted sums of every replicate (first axis)."""
    cols: list
    shift: np.ndarray
    rows: dict = field(default_factory=dict)     # class -> (replicates + 1,)
    columns: dict = field(default_factory=dict)  # class -> {name: (replicates + 1, d)}, with low and high
    pairs: dict = field(default_factory=dict)    # class -> {name: (replicates + 1, pairs i <= j)}

    def whole(self, part: dict) -> dict:
        """All classes together."""
        out: dict = {}
        for sums in part.values():
            for k, v in sums.items():
                fold = {"low": np.minimum, "high": np.maximum}.get(k, np.add)
                out[k] = fold(out[k], v) if k in out else v
        return out


def _columns_and_pairs(x: np.ndarray, shift: np.ndarray, w: np.ndarray, pairs) -> np.ndarray:
    """One row a replicate of all sums, rows without a value left out by column
    or pair."""
    there = ~np.isnan(x)
    z, raw = np.where(there, x - shift, 0.0), np.where(there, x, 0.0)
    pos, nonzero = there & (raw > 0), there & (raw != 0)
    parts = [np.ones((len(x), 1)), there, z, z ** 2, z ** 3, z ** 4, np.log(np.where(pos, raw, 1.0)), pos,
             np.where(nonzero, 1.0 / np.where(nonzero, raw, 1.0), 0.0)]
    if pairs is not None:
        i, j = pairs
        m = there.astype(float)
        parts += [m[:, i] * m[:, j], z[:, i] * m[:, j], m[:, i] * z[:, j], z[:, i] * z[:, j], z[:, i] ** 2 * m[:, j], m[:, i] * z[:, j] ** 2]
    return w.T @ np.hstack(parts)


def _pass(shift: np.ndarray, replicates: int, pairs):
    d = len(shift)
    schema = pa.schema([("cls", pa.string()), ("sums", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit():
            return pa.RecordBatch.from_pylist([{"cls": c, **{k: v.tobytes() for k, v in zip(("sums", "low", "high"), s)}}
                                               for c, s in held.items()], schema=schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                w = replicate_weights(b.column(1).to_numpy(zero_copy_only=False), replicates)
                codes, names = pd.factorize(np.array(b.column(0).to_pylist(), dtype=object), use_na_sentinel=False)
                for k, cls in enumerate(names):
                    cls = cls if isinstance(cls, str) else None
                    xs, ws = x[codes == k], w[codes == k]
                    sums = _columns_and_pairs(xs, shift, ws, pairs)
                    low, high = np.full((replicates + 1, d), np.inf), np.full((replicates + 1, d), -np.inf)
                    for r in range(replicates + 1):
                        drawn = xs[ws[:, r] > 0]
                        if len(drawn):
                            low[r], high[r] = np.fmin.reduce(drawn, initial=np.inf), np.fmax.reduce(drawn, initial=-np.inf)
                    if cls in held:
                        old = held[cls]
                        held[cls] = (old[0] + sums, np.minimum(old[1], low), np.maximum(old[2], high))
                    else:
                        if sum(v[0].size for v in held.values()) + sums.size > 2 * MAX_CLASS_CELLS:
                            yield emit()
                            held.clear()
                        held[cls] = (sums, low, high)
        if held:
            yield emit()
    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {"cls": [pdf["cls"].iloc[0]]}
    for name, fold in (("sums", np.add), ("low", np.minimum), ("high", np.maximum)):
        total = np.frombuffer(pdf[name].iloc[0]).copy()
        for b in pdf[name].iloc[1:]:
            fold(total, np.frombuffer(b), out=total)
        out[name] = [total.tobytes()]
    return pd.DataFrame(out)


def resampled(fr: Frame, replicates: int = 128, seed: int = 1234, with_pairs: bool = False) -> Resampled:
    """The sums of all replicates of the numeric columns, by class (one class,
    None, without a label).  Null and NaN are missing values.  Rows without a
    key are numbered, in their order."""
    fr, cols = keyed(fr), list(fr.num)
    d = len(cols)
    pairs = np.triu_indices(d) if with_pairs else None
    p = len(pairs[0]) if with_pairs else 0
    width = 1 + len(PER_COLUMN) * d + len(gram.PARTS) * p
    if (replicates + 1) * width > MAX_CLASS_CELLS:
        raise NotComputable(f"{replicates} replicates of {width} sums exceed {MAX_CLASS_CELLS} numbers")
    cls = fr.y() if fr.label else F.lit(None).cast("string")
    xs = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    rows = fr.df.select(cls.alias("cls"), hkey(F.col(fr.row_id), seed).alias("draw"), F.array(*xs).alias("x"))
    out = Resampled(cols, gram.shifts(fr.df, cols))
    parts = rows.mapInArrow(_pass(out.shift, replicates, pairs), STATE)
    total = gram.added_up(parts, ["cls"], _merge, STATE)
    most = max(MAX_DRIVER_CELLS // ((replicates + 1) * width), 1)
    for r in collect_bounded(total, f"classes of {replicates} replicates", most):  # one row a class, bounded numbers
        sums = np.frombuffer(r["sums"]).reshape(replicates + 1, width)
        at = 1 + len(PER_COLUMN) * d
        out.rows[r["cls"]] = sums[:, 0]
        out.columns[r["cls"]] = {k: sums[:, 1 + i * d:1 + (i + 1) * d] for i, k in enumerate(PER_COLUMN)} | {
            k: np.frombuffer(r[k]).reshape(replicates + 1, d) for k in ("low", "high")}
        out.pairs[r["cls"]] = {k: sums[:, at + i * p:at + (i + 1) * p] for i, k in enumerate(gram.PARTS)} if with_pairs else {}
    return out


def replicate_frame(fr: Frame, replicate: int, seed: int = 1234) -> Frame:
    """The rows of one replicate, each as often as its weight says, without a
    row key (its copies are rows of their own).  Replicate 0 is ``fr``."""
    fr = keyed(fr)
    if replicate == 0:
        return fr.with_df(fr.df)

    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(replicate_weights(b.to_numpy(), replicate)[:, replicate].astype("int32"))

    times = F.pandas_udf(weight, "int")(hkey(F.col(fr.row_id), seed))
    copies = (fr.df.withColumn("_times", times).where("_times > 0")
              .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))))
    return keyed(fr.with_df(copies.drop("_times", "_copy", fr.row_id), row_id=None))


# ------------------------------------------------------- features of replicates
def _central(s: dict) -> tuple:
    n = s["n"]
    mu = s["s1"] / n
    m2, m3, m4 = s["s2"] / n, s["s3"] / n, s["s4"] / n
    return n, mu, m2 - mu ** 2, m3 - 3 * mu * m2 + 2 * mu ** 3, m4 - 4 * mu * m3 + 6 * mu ** 2 * m2 - 3 * mu ** 4


def _column_values(re: Resampled) -> dict:
    """{feature: (replicates + 1, d)} of the features of single columns."""
    s = re.whole(re.columns)
    with np.errstate(all="ignore"):
        n, mu, c2, c3, c4 = _central(s)
        c2 = np.where(s["low"] == s["high"], 0.0, np.maximum(c2, 0.0))
        var = np.where(n > 1, c2 * n / (n - 1), np.nan)
        low, high = (np.where(np.isinf(s[k]) & (n == 0), np.nan, s[k]) for k in ("low", "high"))
        return {"mean": re.shift + mu, "var": var, "sd": np.sqrt(var), "min": low, "max": high, "range": high - low,
                "skewness": c3 / c2 ** 1.5 * ((n - 1) / n) ** 1.5, "kurtosis": c4 / c2 ** 2 * (1 - 1 / n) ** 2 - 3,
                "g_mean": np.where(low < 0, np.nan, np.where(low < 1e-10, 0.0, np.exp(s["ln"] / s["pos"]))),
                "h_mean": np.where(low < 0, np.nan, np.where(low == 0, 0.0, n / s["inv"]))}


def _square(v: np.ndarray, d: int) -> np.ndarray:
    out = np.empty((d, d))
    i, j = np.triu_indices(d)
    out[i, j] = out[j, i] = v
    return out


def _scatter(re: Resampled, r: int) -> M.ClassScatter:
    """Class moments of one replicate, of the classes that it holds."""
    there = sorted((c for c, n in re.rows.items() if n[r] > 0), key=lambda c: (c is not None, c))
    with np.errstate(all="ignore"):
        means = [re.shift + re.columns[c]["s1"][r] / re.columns[c]["n"][r] for c in there]
        covs = [_square(gram.covariance(*(re.pairs[c][k][r] for k in gram.PARTS)), len(re.cols)) for c in there]
    return M.ClassScatter(there, np.array([re.rows[c][r] for c in there]), np.array(means), np.array(covs), re.cols)


def _gravity(re: Resampled, r: int, norm_ord: float = 2.0) -> float:
    there = sorted((c for c, n in re.rows.items() if n[r] > 0), key=lambda c: (c is not None, c))
    if len(there) < 2:
        return float("nan")
    major = max(there, key=lambda c: re.rows[c][r])  # the first of equals
    minor = min((c for c in there if c != major), key=lambda c: re.rows[c][r])
    with np.errstate(all="ignore"):
        a, b = (re.columns[c]["s1"][r] / re.columns[c]["n"][r] for c in (major, minor))
    return float(np.linalg.norm(a - b, ord=norm_ord))


def _discriminant(name: str):
    def value(re: Resampled, r: int) -> np.ndarray:
        return M.DISCRIMINANT[name](M.discriminant_eigs(_scatter(re, r)))
    return value


def _pair_values(re: Resampled, measure) -> np.ndarray:
    """(replicates + 1, pairs i > j), as the pair features order them."""
    d, s = len(re.cols), re.whole(re.pairs)
    v = measure(*(s[k] for k in gram.PARTS))
    at = {pair: k for k, pair in enumerate(zip(*np.triu_indices(d)))}
    return np.abs(v[:, [at[j, i] for i in range(d) for j in range(i)]])


def _shares(re: Resampled, r: int) -> np.ndarray:
    n = np.array([re.rows[c][r] for c in sorted(re.rows, key=lambda c: (c is not None, c)) if c is not None and re.rows[c][r] > 0])
    return n / sum(v[r] for v in re.rows.values())


COLUMN = ("g_mean", "h_mean", "kurtosis", "max", "mean", "min", "range", "sd", "skewness", "var")
#: feature -> value(s) of one replicate
SINGLE = {
    "nr_inst": lambda re, r: sum(v[r] for v in re.rows.values()),
    "nr_class": lambda re, r: float(len(_shares(re, r))),
    "freq_class": _shares,
    "gravity": _gravity,
    "eigenvalues": lambda re, r: np.linalg.eigvalsh(_square(gram.covariance(*(re.whole(re.pairs)[k][r] for k in gram.PARTS)), len(re.cols))),
    "sd_ratio": lambda re, r: M.box_m(_scatter(re, r)),
    **{name: _discriminant(name) for name in ("can_cor", "nr_disc", "w_lambda", "p_trace", "lh_trace", "roy_root")},
}
PAIRS = ("cov", "cor", "nr_cor_attr")
#: Features that moments determine, and those of them that take pairs of columns.
FEATURES = (*COLUMN, *SINGLE, *PAIRS)
NEEDS_PAIRS = {*PAIRS, "eigenvalues", "sd_ratio", "can_cor", "nr_disc", "w_lambda", "p_trace", "lh_trace", "roy_root"}
GENERAL = {"nr_inst", "nr_class", "freq_class"}


def replicate_values(re: Resampled, feature: str) -> list[np.ndarray]:
    """The values of a feature, one vector a replicate, first the data's own."""
    if feature in COLUMN:
        return list(_column_values(re)[feature])
    if feature in PAIRS:
        v = _pair_values(re, gram.MEASURES["cov" if feature == "cov" else "cor"])
        return list(v) if feature != "nr_cor_attr" else [np.array([(row >= 0.5).mean() if len(row) else np.nan]) for row in v]
    out = []
    for r in range(len(next(iter(re.rows.values())))):
        try:
            out.append(np.atleast_1d(SINGLE[feature](re, r)).astype(float))
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            out.append(np.array([np.nan]))
    return out


def intervals(values: np.ndarray, confidence) -> list[tuple]:
    """(confidence, lower, upper): the data's value less the quantiles of the
    replicates' deviations from it.  Replicates without a value are left out."""
    delta = values[1:] - values[0]
    delta = delta[~np.isnan(delta)]
    out = []
    for c in confidence:
        if not 0 < c < 1:
            raise ValueError("confidence must be between 0 and 1")
        lo, hi = np.quantile(delta, [(1 - c) / 2, 1 - (1 - c) / 2]) if len(delta) and np.isfinite(values[0]) else (np.nan, np.nan)
        out.append((c, float(values[0] - hi), float(values[0] - lo)))
    return out
