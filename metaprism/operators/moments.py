"""Moments kernel: one distributed pass, small d x d algebra on the driver.

``class_scatter`` runs a single ``groupBy(label).agg`` with per-class counts,
means and sample covariances of every numeric pair.  Partial aggregation makes
the shuffle O(classes x d^2) regardless of row count or class skew; the
returned matrices are d x d per class, which is what the statistical,
complexity and landmarking operators need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, NotComputable, collect_bounded
from . import gram

#: Columns for which every pair is an expression of one aggregate; more go by
#: the blocked kernel (``gram``), with the same values.
MAX_PAIRWISE_COLS = 6
#: Numbers of class covariances that the driver takes for its algebra.
MAX_DRIVER_CELLS = 40_000_000


@dataclass
class ClassScatter:
    classes: list[str]
    counts: np.ndarray        # (k,)
    means: np.ndarray         # (k, d)
    covs: np.ndarray          # (k, d, d) sample covariance, ddof 1
    cols: list[str]

    @property
    def n(self) -> float:
        return float(self.counts.sum())

    @property
    def grand_mean(self) -> np.ndarray:
        return (self.counts[:, None] * self.means).sum(0) / self.n

    def within(self) -> np.ndarray:
        w = np.nan_to_num(self.covs) * (self.counts - 1)[:, None, None]
        return w.sum(0)

    def between(self) -> np.ndarray:
        dm = self.means - self.grand_mean
        return (self.counts[:, None, None] * dm[:, :, None] * dm[:, None, :]).sum(0)

    def total_cov(self) -> np.ndarray:
        return (self.within() + self.between()) / (self.n - 1)


def _pair_aggs(cols: list[str]):
    out = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            out.append(F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}_{j}"))
    return out


def class_scatter(fr: Frame, cols: list[str] | None = None) -> ClassScatter:
    """Memoised per Frame: every feature that needs class moments (canonical
    correlations, Box's M, f1, f1v, ch, discriminant models) shares one pass."""
    cols = list(cols if cols is not None else fr.num)
    key = ("_class_scatter", tuple(cols))
    return fr.memo(key, lambda: _class_scatter(fr, cols))


def _class_scatter(fr: Frame, cols: list[str]) -> ClassScatter:
    d = len(cols)
    wide = d > MAX_PAIRWISE_COLS
    aggs = [F.count(F.lit(1)).alias("n")]
    if not wide:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)]
        aggs += _pair_aggs(cols)
    rows = sorted(collect_bounded(fr.df.groupBy(fr.y().alias("cls")).agg(*aggs), "classes"),
                  key=lambda r: (r["cls"] is not None, r["cls"]))  # rows without a label are a class, the first
    k = len(rows)
    counts = np.array([r["n"] for r in rows], dtype=float)
    if wide:
        _check_cells(k, d)
        by_class = gram.covariances(fr.df, cols, fr.y())
        found = [by_class[r["cls"]] for r in rows]
        return ClassScatter([r["cls"] for r in rows], counts, np.array([m for m, _ in found]).reshape(k, d),
                            np.array([c for _, c in found]).reshape(k, d, d), cols)
    means = np.array([[r[f"m_{i}"] for i in range(d)] for r in rows], dtype=float).reshape(k, d)
    covs = np.zeros((k, d, d))
    for c, r in enumerate(rows):
        for i in range(d):
            for j in range(i, d):
                v = r[f"c_{i}_{j}"]
                v = np.nan if v is None else v
                covs[c, i, j] = covs[c, j, i] = v
    return ClassScatter([r["cls"] for r in rows], counts, means, covs, cols)


def _check_cells(k: int, d: int) -> None:
    if k * d * d > MAX_DRIVER_CELLS:
        raise NotComputable(f"{k} classes of {d} x {d} covariances exceed {MAX_DRIVER_CELLS} numbers")


def covariance(fr: Frame, cols: list[str] | None = None) -> tuple[np.ndarray, float]:
    """Sample covariance matrix (ddof 1) of the numeric columns, one pass
    (memoised per Frame)."""
    cols = list(cols if cols is not None else fr.num)
    key = ("_covariance", tuple(cols))
    return fr.memo(key, lambda: _covariance(fr, cols))


def _covariance(fr: Frame, cols: list[str]) -> tuple[np.ndarray, float]:
    d = len(cols)
    if d > MAX_PAIRWISE_COLS:
        _check_cells(1, d)
        return gram.covariances(fr.df, cols).get(None, (None, np.full((d, d), np.nan)))[1], float(fr.count())
    r = fr.df.agg(F.count(F.lit(1)).alias("n"), *_pair_aggs(cols)).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v = r[f"c_{i}_{j}"]
            cov[i, j] = cov[j, i] = np.nan if v is None else v
    return cov, float(r["n"])


def discriminant_eigs(sc: ClassScatter) -> np.ndarray:
    """Eigenvalues of W^-1 B, largest first, min(k-1, d) of them."""
    W, B = sc.within(), sc.between()
    k, d = len(sc.classes), len(sc.cols)
    m = min(k - 1, d)
    vals = np.linalg.eigvals(np.linalg.pinv(W) @ B)
    vals = np.sort(np.clip(vals.real, 0.0, None))[::-1]
    return vals[:m]


#: Features of the discriminant eigenvalues.
DISCRIMINANT = {
    "can_cor": lambda lam: np.sqrt(lam / (1.0 + lam)),
    "nr_disc": lambda lam: float(len(lam)),
    "w_lambda": lambda lam: float(np.exp(-np.sum(np.log1p(lam)))),
    "p_trace": lambda lam: float(np.sum(lam / (1.0 + lam))),
    "lh_trace": lambda lam: float(np.sum(lam)),
    "roy_root": lambda lam: float(np.max(lam)) if len(lam) else float("nan"),
}


def box_m(sc: ClassScatter, reference_flip: bool = False) -> float:
    """Box's M of the class covariance matrices, per column and degree of freedom."""
    n, d, k = sc.n, len(sc.cols), len(sc.classes)
    covs = np.flip(sc.covs, axis=(0, 1)) if reference_flip else sc.covs
    w = sc.counts - 1.0
    with np.errstate(all="ignore"):
        pooled = (w[:, None, None] * covs).sum(0) / (n - k)
        gamma = 1.0 - ((2.0 * d ** 2 + 3.0 * d - 1.0) / (6.0 * (d + 1.0) * (k - 1.0))) * (
            np.sum(1.0 / w) - 1.0 / (n - k))
        logdets = [np.log(np.linalg.det(S)) for S in covs]
        m = gamma * ((n - k) * np.log(np.linalg.det(pooled)) - np.dot(w, logdets))
        return float("nan") if (np.isinf(m) or np.isnan(m)) else float(np.exp(m / (d * (n - k))))


def values_frame(spark, feature: str, values, attrs=None, classes=None) -> DataFrame:
    """Long rows for driver-computed small results (d or k values)."""
    from ..frame import LONG_SCHEMA
    rows = []
    for i, v in enumerate(values):
        a = None if attrs is None else attrs[i]
        c = None if classes is None else classes[i]
        rows.append((feature, a, c, i, None if v is None else float(v)))
    return spark.createDataFrame(rows, LONG_SCHEMA)
