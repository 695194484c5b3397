"""Rank-based normality tests of whole columns.

Both statistics are sums over the sorted values, weighted by rank.  The values
of all columns are counted and range-partitioned once (as for order
statistics); a value with n_v copies holds a run of ranks, and its weight is the
sum over that run.  So a task streams its own values, and no column, however
long or however often one value repeats, meets in one task.

* Anderson-Darling: A2 = -n - 1/n sum (2i - 1) (ln F(z_i) + ln(1 - F(z_(n+1-i)))).
* Shapiro-Wilk: W with Royston's coefficients, of which all but the two at
  either end are proportional to the normal scores m_i = Phi^-1((i - 3/8) / (n + 1/4)).
  Runs longer than ``DIRECT`` ranks are summed by Euler-Maclaurin from the
  integrals of the scores, away from the ends, where its error is below 1e-9.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import value_counts
from .ranking import _ranged

#: Ranks of a run that are summed one by one, and ranks at each end that always are.
DIRECT = 64
ENDS = 512
_N = NormalDist()

# Royston (1995), coefficients of the two largest weights and of the p-value, by ascending power.
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
ROYSTON_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_MEAN_SMALL = (0.544, -0.39978, 0.025054, -6.714e-4)
ROYSTON_SD_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_SD = (-0.4803, -0.082676, 0.0030302)
ROYSTON_GAMMA = (-2.273, 0.459)
# Stephens, critical values of A2 with estimated mean and sd, and their levels in per cent.
ANDERSON_LEVELS = (15.0, 10.0, 5.0, 2.5, 1.0)
ANDERSON_VALUES = (0.576, 0.656, 0.787, 0.918, 1.092)


def _poly(c, x: float) -> float:
    return sum(v * x ** k for k, v in enumerate(c))


def scores(i, n: int) -> np.ndarray:
    """Normal scores of ranks ``i`` (1-based) of ``n``."""
    p = (np.asarray(i, dtype=float) - 0.375) / (n + 0.25)
    return np.array([_N.inv_cdf(v) for v in p.tolist()])


def _run_sum(a: int, b: int, n: int, square: bool = False) -> float:
    """Sum of the scores (or their squares) of ranks a to b."""
    if b < a:
        return 0.0
    if b - a < DIRECT:
        z = scores(np.arange(a, b + 1), n)
        return float((z * z if square else z).sum())
    lo, hi = max(a, min(ENDS + 1, b + 1)), min(b, max(n - ENDS, a - 1))
    if lo > hi or hi - lo < DIRECT:
        z = scores(np.arange(a, b + 1), n)
        return float((z * z if square else z).sum())
    total = 0.0
    for x, y in ((a, lo - 1), (hi + 1, b)):  # at most ENDS ranks each
        if x <= y:
            z = scores(np.arange(x, y + 1), n)
            total += float((z * z if square else z).sum())
    m, (p, q) = n + 0.25, ((lo - 0.875) / (n + 0.25), (hi + 0.125) / (n + 0.25))
    zp, zq = _N.inv_cdf(p), _N.inv_cdf(q)
    fp, fq = _N.pdf(zp), _N.pdf(zq)
    if square:
        return total + m * ((q - zq * fq) - (p - zp * fp)) - (2 * zq / fq - 2 * zp / fp) / (24 * m)
    return total + m * (fp - fq) - (1 / fq - 1 / fp) / (24 * m)


def _weights(n: int) -> tuple[float, dict[int, float]]:
    """The factor of the inner scores and {rank: weight} of the outer ranks."""
    if n == 3:
        return 0.0, {1: -math.sqrt(0.5), 3: math.sqrt(0.5)}
    m1, m2 = scores([n, n - 1], n).tolist()
    ss, u = _run_sum(1, n, n, square=True), 1.0 / math.sqrt(n)
    last = m1 / math.sqrt(ss) + _poly(ROYSTON_LAST, u)
    if n <= 5:
        rest = (ss - 2 * m1 * m1) / (1 - 2 * last * last)
        return 1 / math.sqrt(rest), {1: -last, n: last}
    near = m2 / math.sqrt(ss) + _poly(ROYSTON_NEXT, u)
    rest = (ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last * last - 2 * near * near)
    return 1 / math.sqrt(rest), {1: -last, 2: -near, n - 1: near, n: last}


def shapiro_pvalue(w: float, n: int) -> float:
    """Royston's p-value of W."""
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0
    y, x = math.log1p(-w), math.log(n)
    if n <= 11:
        g = _poly(ROYSTON_GAMMA, n)
        if y >= g:
            return 0.0
        y, mean, sd = -math.log(g - y), _poly(ROYSTON_MEAN_SMALL, n), math.exp(_poly(ROYSTON_SD_SMALL, n))
    else:
        mean, sd = _poly(ROYSTON_MEAN, x), math.exp(_poly(ROYSTON_SD, x))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def anderson_critical(n: int, threshold: float) -> float:
    """The critical value whose level is nearest to ``threshold``.  The levels
    are compared as the figures they are listed by, 15 to 1, so a threshold below
    1 takes the last."""
    k = min(range(len(ANDERSON_LEVELS)), key=lambda i: abs(ANDERSON_LEVELS[i] - threshold))
    return round(ANDERSON_VALUES[k] / (1.0 + 4.0 / n - 25.0 / n / n), 3)


def _log_cdf(z: float) -> float:
    if z > -35:
        return math.log(0.5 * math.erfc(-z / math.sqrt(2)))
    t = 1 / (z * z)
    return -0.5 * z * z - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log1p(-t + 3 * t * t - 15 * t ** 3)


def rank_statistics(df: DataFrame, cols: Mapping[str, Column]) -> dict[str, dict]:
    """{column: {n, w, a2}} over all non-null values.

    ``w`` (Shapiro-Wilk) needs three values, ``a2`` (Anderson-Darling) two;
    without them, or when all values are equal, they are None.  NaN makes both
    None.
    """
    names = list(cols)
    xs = [c.cast("double") for c in cols.values()]
    r = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(xs)
                 for k, f in (("n", F.count), ("m", F.avg), ("d", F.stddev_samp), ("a", F.min), ("z", F.max))]).first()
    out = {c: {"n": r[f"n{i}"], "w": None, "a2": None} for i, c in enumerate(names)}
    fits = {i: (r[f"n{i}"], r[f"m{i}"], r[f"d{i}"], _weights(r[f"n{i}"]) if r[f"n{i}"] > 2 else None)
            for i in range(len(names))
            if r[f"n{i}"] > 1 and r[f"a{i}"] != r[f"z{i}"] and all(math.isfinite(r[f"{k}{i}"]) for k in "madz")}
    if not fits:
        return out
    ranged = _ranged(value_counts(df, {names[i]: xs[i] for i in fits}), ["attr", "value"], None)
    key = dict(enumerate(fits))  # value_counts numbers the columns that it is given
    before: dict = {}
    starts = []
    for attr, pid, n in sorted(tuple(t) for t in ranged.groupBy("attr", "_pid").agg(F.sum("n")).collect()):  # one a range and column
        starts.append((attr, pid, before.get(attr, 0)))
        before[attr] = before.get(attr, 0) + n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "attr int, _pid int, start long"))
    run = Window.partitionBy("_pid", "attr").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = (ranged.withColumn("upto", F.sum("n").over(run)).join(offsets, ["attr", "_pid"])
             .select("attr", "value", "n", (F.col("start") + F.col("upto") - F.col("n")).alias("below")))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for attr, part in b.groupby("attr"):
                n, mean, sd, weights = fits[key[attr]]
                x, c, r0 = part["value"].to_numpy(), part["n"].to_numpy(), part["below"].to_numpy()
                w = 0.0
                if weights is not None:
                    factor, outer = weights
                    g = np.empty(len(x))
                    one = c == 1
                    g[one] = scores(r0[one] + 1, n)
                    g[~one] = [_run_sum(int(a) + 1, int(a + k), n) for a, k in zip(r0[~one], c[~one])]
                    g *= factor
                    for rank, weight in outer.items():
                        hit = (r0 < rank) & (rank <= r0 + c)
                        g[hit] += weight - factor * scores([rank], n)[0]
                    w = float((g * (x - mean)).sum())
                z = ((x - mean) / sd).tolist()
                lower, upper = c * (2.0 * r0 + c), c * (2.0 * (n - r0) - c)
                a = float((lower * [_log_cdf(v) for v in z] + upper * [_log_cdf(-v) for v in z]).sum())
                old = sums.get(attr, (0.0, 0.0))
                sums[attr] = (old[0] + w, old[1] + a)
        yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["attr", "w", "a"]).astype({"attr": "int32", "w": float, "a": float})

    total = ranks.mapInPandas(partial, "attr int, w double, a double").groupBy("attr").agg(F.sum("w").alias("w"), F.sum("a").alias("a"))
    for t in total.collect():  # one row a column
        n, _, sd, weights = fits[key[t["attr"]]]
        got = out[names[key[t["attr"]]]]
        got["a2"] = -n - t["a"] / n
        got["w"] = t["w"] ** 2 / (sd * sd * (n - 1)) if weights is not None else None
    return out
