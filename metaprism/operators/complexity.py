"""Complexity meta-features (X1-X22) that need no row-pair distances.

f1/f1v/f2/f3/f4 rest on class-wise moments and ranges (one ``groupBy``), then
literal-driven conditional counts; c1/c2/t2-t4 on class counts and a PCA
cut.  The neighbourhood measures (n1-n4, t1, lsc, density, cls_coef, hubs)
are in ``pairs.py``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, unpivot, collect_bounded
from . import moments as M


def _x(c):
    return F.col(c).cast("double")


def ft_f1(fr: Frame) -> DataFrame:
    """Per column 1 / (1 + between-class SS / within-class SS)."""
    sc = M.class_scatter(fr)
    gm = sc.grand_mean
    numer = (sc.counts[:, None] * (sc.means - gm) ** 2).sum(0)
    denom = np.array([((sc.counts - 1) * np.nan_to_num(sc.covs[:, i, i])).sum() for i in range(len(sc.cols))])
    with np.errstate(divide="ignore", invalid="ignore"):
        f1 = 1.0 / (1.0 + numer / denom)
    return M.values_frame(fr.spark, "f1", f1, attrs=list(fr.num))


def class_ranges(fr: Frame):
    """Sorted classes with count, min and max of every numeric column."""
    rows = fr.df.groupBy(fr.y().alias("cls")).agg(
        F.count(F.lit(1)).alias("cnt"),
        *[F.min(_x(c)).alias(f"lo{i}") for i, c in enumerate(fr.num)],
        *[F.max(_x(c)).alias(f"hi{i}") for i, c in enumerate(fr.num)])
    rows = collect_bounded(rows, "classes")  # one row per class, size checked
    rows.sort(key=lambda r: r["cls"])
    d = len(fr.num)
    lo = np.array([[r[f"lo{i}"] for i in range(d)] for r in rows], dtype=float)
    hi = np.array([[r[f"hi{i}"] for i in range(d)] for r in rows], dtype=float)
    cnt = np.array([r["cnt"] for r in rows], dtype=float)
    return [r["cls"] for r in rows], cnt, lo, hi


def ovo_pairs(k: int):
    return [(a, b) for a in range(k) for b in range(a + 1, k)]


def ft_f2(fr: Frame) -> DataFrame:
    classes, cnt, lo, hi = class_ranges(fr)
    vals = []
    for a, b in ovo_pairs(len(classes)):
        minmax = np.minimum(hi[a], hi[b])
        maxmin = np.maximum(lo[a], lo[b])
        maxmax = np.maximum(hi[a], hi[b])
        minmin = np.minimum(lo[a], lo[b])
        with np.errstate(divide="ignore", invalid="ignore"):
            vals.append(float(np.prod(np.maximum(0.0, minmax - maxmin) / (maxmax - minmin))))
    return M.values_frame(fr.spark, "f2", vals,
                          classes=[f"{classes[a]}|{classes[b]}" for a, b in ovo_pairs(len(classes))])


def _overlap_counts(fr: Frame, classes, lo, hi, pairs, active=None):
    """Rows of each pair's two classes inside the pair's overlap interval, per
    column: one grouped pass with literal bounds (pairs x columns counts)."""
    d = len(fr.num)
    y = fr.y()
    aggs = []
    for p, (a, b) in enumerate(pairs):
        maxmin = np.maximum(lo[a], lo[b])
        minmax = np.minimum(hi[a], hi[b])
        in_pair = y.isin(classes[a], classes[b])
        for i, c in enumerate(fr.num):
            cond = in_pair & (_x(c) >= float(maxmin[i])) & (_x(c) <= float(minmax[i]))
            if active is not None:
                cond = cond & active
            aggs.append(F.count_if(cond).alias(f"o{p}_{i}"))
    r = fr.df.agg(*aggs).first()
    return np.array([[r[f"o{p}_{i}"] for i in range(d)] for p in range(len(pairs))], dtype=float)


def ft_f3(fr: Frame) -> DataFrame:
    classes, cnt, lo, hi = class_ranges(fr)
    pairs = ovo_pairs(len(classes))
    ov = _overlap_counts(fr, classes, lo, hi, pairs)
    vals = [float(ov[p].min() / (cnt[a] + cnt[b])) for p, (a, b) in enumerate(pairs)]
    return M.values_frame(fr.spark, "f3", vals, classes=[f"{classes[a]}|{classes[b]}" for a, b in pairs])


def ft_f4(fr: Frame) -> DataFrame:
    """Collective feature efficiency per class pair.

    Repeatedly drop the rows separable by the column with the least overlap
    (rows outside its overlap interval) and recompute the interval on the
    rows left, until no column remains or nothing is left; value = rows left
    / rows of the pair.  All class pairs advance together: each step is two
    aggregates over the data (class ranges on the rows alive, then overlap
    counts), whatever the number of pairs.
    """
    classes, cnt, _, _ = class_ranges(fr)
    pairs = ovo_pairs(len(classes))
    d = len(fr.num)
    y = fr.y()
    x = [_x(c) for c in fr.num]
    alive = [y.isin(classes[a], classes[b]) for a, b in pairs]
    remaining = [list(range(d)) for _ in pairs]
    left = [cnt[a] + cnt[b] for a, b in pairs]
    done = [False] * len(pairs)
    for _ in range(d):
        act = [p for p in range(len(pairs)) if not done[p] and remaining[p]]
        if not act:
            break
        aggs = [F.count_if(alive[p]).alias(f"n{p}") for p in act]
        for p in act:
            a, b = pairs[p]
            for i in remaining[p]:
                for side, cl in (("a", classes[a]), ("b", classes[b])):
                    v = F.when(alive[p] & (y == cl), x[i])
                    aggs += [F.min(v).alias(f"l{side}{p}_{i}"), F.max(v).alias(f"h{side}{p}_{i}")]
        r = fr.df.agg(*aggs).first()
        bounds = {}
        for p in act:
            if r[f"n{p}"] == 0:
                left[p], done[p] = 0, True
                continue
            i0 = remaining[p][0]
            if r[f"la{p}_{i0}"] is None or r[f"lb{p}_{i0}"] is None:
                left[p], done[p] = 0, True  # one class emptied: no overlap region remains
                continue
            bounds[p] = {i: (max(r[f"la{p}_{i}"], r[f"lb{p}_{i}"]), min(r[f"ha{p}_{i}"], r[f"hb{p}_{i}"]))
                         for i in remaining[p]}
        if not bounds:
            break
        cnts = fr.df.agg(*[F.count_if(alive[p] & (x[i] >= lo) & (x[i] <= hi)).alias(f"o{p}_{i}")
                           for p, bd in bounds.items() for i, (lo, hi) in bd.items()]).first()
        for p, bd in bounds.items():
            best = min(remaining[p], key=lambda i: (cnts[f"o{p}_{i}"], remaining[p].index(i)))
            lo, hi = bd[best]
            alive[p] = alive[p] & (x[best] >= lo) & (x[best] <= hi)
            remaining[p].remove(best)
            left[p] = cnts[f"o{p}_{best}"]
            if left[p] == 0:
                done[p] = True
    vals = [float(left[p] / (cnt[a] + cnt[b])) for p, (a, b) in enumerate(pairs)]
    return M.values_frame(fr.spark, "f4", vals, classes=[f"{classes[a]}|{classes[b]}" for a, b in pairs])


def ft_f1v(fr: Frame) -> DataFrame:
    """Directional-vector Fisher ratio per class pair (pooled covariance)."""
    sc = M.class_scatter(fr)
    k = len(sc.classes)
    vals = []
    for a, b in ovo_pairs(k):
        na, nb = sc.counts[a], sc.counts[b]
        pa, pb = na / (na + nb), nb / (na + nb)
        W = pa * np.nan_to_num(sc.covs[a]) + pb * np.nan_to_num(sc.covs[b])
        dm = sc.means[a] - sc.means[b]
        B = np.outer(dm, dm)
        dvec = np.linalg.pinv(W) @ dm
        num = float(dvec @ B @ dvec)
        den = float(dvec @ W @ dvec)
        vals.append(1.0 / (1.0 + num / den) if den != 0 else float("nan"))
    return M.values_frame(fr.spark, "f1v", vals,
                          classes=[f"{sc.classes[a]}|{sc.classes[b]}" for a, b in ovo_pairs(k)])


def _class_counts(fr: Frame):
    return fr.df.groupBy(fr.y()).agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def ft_c1(fr: Frame) -> DataFrame:
    n = float(fr.count())
    agg = _class_counts(fr).agg((-F.sum((F.col("cnt") / n) * F.ln(F.col("cnt") / n))).alias("h"),
                                F.count(F.lit(1)).cast("double").alias("k"))
    return unpivot(agg, [entry("c1", F.col("h") / F.ln(F.col("k")))])


def ft_c2(fr: Frame) -> DataFrame:
    n = float(fr.count())
    agg = _class_counts(fr).agg(F.sum(F.col("cnt") / (F.lit(n) - F.col("cnt"))).alias("s"),
                                F.count(F.lit(1)).cast("double").alias("k"))
    ir = (F.col("k") - 1.0) / F.col("k") * F.col("s")
    return unpivot(agg, [entry("c2", 1.0 - 1.0 / ir)])


def ft_t2(fr: Frame) -> DataFrame:
    n = float(fr.count())
    return M.values_frame(fr.spark, "t2", [len(fr.num) / n])


def pca_components_95(fr: Frame, share: float = 0.95) -> int:
    cov, _ = M.covariance(fr)
    ev = np.sort(np.clip(np.linalg.eigvalsh(cov), 0, None))[::-1]
    tot = ev.sum()
    if tot <= 0:
        return 0
    return int(np.searchsorted(np.cumsum(ev) / tot, share - 1e-12) + 1)


def ft_t3(fr: Frame) -> DataFrame:
    n = float(fr.count())
    return M.values_frame(fr.spark, "t3", [pca_components_95(fr) / n])


def ft_t4(fr: Frame) -> DataFrame:
    return M.values_frame(fr.spark, "t4", [pca_components_95(fr) / len(fr.num)])


FEATURES = {"c1": ft_c1, "c2": ft_c2, "f1": ft_f1, "f1v": ft_f1v, "f2": ft_f2, "f3": ft_f3, "f4": ft_f4,
            "t2": ft_t2, "t3": ft_t3, "t4": ft_t4}
NEEDS_LABEL = {"c1", "c2", "f1", "f1v", "f2", "f3", "f4"}
_ = math


# ------------------------------------------------------------ X6-X8 linear SVM
def _svm_pairs(fr: Frame, max_iter: int = 100, seed: int = 0, parallelism: int = 32):
    """Per class pair: standardise on the pair's rows, fit a hinge-loss linear
    SVM (C = 2 -> regParam = 1 / (2 n)); returns [(pair, rows, (assembler,
    scaler, model), n_a + n_b, (class_a, class_b))].  Fits are shared by l1,
    l2 and l3 (memoised per Frame) and submitted concurrently (each fit is its
    own distributed job; the driver only waits)."""
    return fr.memo(("svm_pairs", max_iter, seed), lambda: _fit_svm_pairs(fr, max_iter, parallelism))


def _fit_svm_pairs(fr: Frame, max_iter: int, parallelism: int):
    from concurrent.futures import ThreadPoolExecutor
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    classes, cnt, _, _ = class_ranges(fr)
    y = fr.y()

    def fit(pair):
        a, b = pair
        sub = fr.df.where(y.isin(classes[a], classes[b])).withColumn("_t", (y == classes[a]).cast("double"))
        va = VectorAssembler(inputCols=list(fr.num), outputCol="_v", handleInvalid="keep")
        sc = StandardScaler(inputCol="_v", outputCol="_f", withMean=True, withStd=True).fit(va.transform(sub))
        data = sc.transform(va.transform(sub)).cache()
        n = cnt[a] + cnt[b]
        svm = LinearSVC(featuresCol="_f", labelCol="_t", regParam=1.0 / (2.0 * n), maxIter=max_iter, tol=1e-2,
                        rawPredictionCol="_raw", predictionCol="_p").fit(data)
        return f"{classes[a]}|{classes[b]}", data, (va, sc, svm), n, (classes[a], classes[b])

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fit, ovo_pairs(len(classes))))


def _margin():
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col("_raw"))[1]


def _pair_predictions(fr: Frame, max_iter: int, interpolated: bool = False, seed: int = 0) -> DataFrame:
    """(pair, _t, _p, margin) for every pair's training rows (or the pair's
    interpolated rows), as ONE union so the per-pair measures are one job."""
    from .splits import interpolate_rows
    outs = []
    # class-wise blends are drawn once for all classes; each pair takes its
    # two classes' interpolated rows
    inter_all = interpolate_rows(fr, seed=seed + 1).cache() if interpolated else None
    for k, (name, data, (va, sc, svm), n, (ca, cb)) in enumerate(_svm_pairs(fr, max_iter)):
        if interpolated:
            inter = inter_all.where(F.col(fr.label).cast("string").isin(ca, cb))
            inter = inter.withColumn("_t", (F.col(fr.label).cast("string") == ca).cast("double"))
            out = svm.transform(sc.transform(va.transform(inter)))
        else:
            out = svm.transform(data)
        outs.append(out.select(F.lit(k).alias("pair"), F.lit(name).alias("name"), F.lit(float(n)).alias("n"),
                               "_t", "_p", _margin().alias("m")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def ft_l1(fr: Frame, max_iter: int = 100) -> DataFrame:
    """1 - 1 / (1 + sum |margin| of misclassified rows / n) per class pair."""
    pr = _pair_predictions(fr, max_iter)
    agg = pr.groupBy("pair", "name", "n").agg(F.sum(F.when(F.col("_p") != F.col("_t"), F.abs("m"))).alias("s"))
    v = 1.0 - 1.0 / (1.0 + F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n"))
    return agg.select(entry("l1", v, cls=F.col("name"), idx=F.col("pair")).alias("e")).select("e.*")


def ft_l2(fr: Frame, max_iter: int = 100) -> DataFrame:
    """Training error of the pair's linear SVM."""
    pr = _pair_predictions(fr, max_iter)
    agg = pr.groupBy("pair", "name").agg(F.avg((F.col("_p") != F.col("_t")).cast("double")).alias("v"))
    return agg.select(entry("l2", F.col("v"), cls=F.col("name"), idx=F.col("pair")).alias("e")).select("e.*")


def ft_l3(fr: Frame, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """Error of the pair's SVM on interpolated rows of the pair (R5), the
    seed moving per pair."""
    pr = _pair_predictions(fr, max_iter, interpolated=True, seed=seed)
    agg = pr.groupBy("pair", "name").agg(F.avg((F.col("_p") != F.col("_t")).cast("double")).alias("v"))
    return agg.select(entry("l3", F.col("v"), cls=F.col("name"), idx=F.col("pair")).alias("e")).select("e.*")


FEATURES.update({"l1": ft_l1, "l2": ft_l2, "l3": ft_l3})
NEEDS_LABEL.update({"l1", "l2", "l3"})
