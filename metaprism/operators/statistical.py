"""Statistical meta-features.

Per-column features share one wide aggregate: each feature names the base
aggregates it needs (count, moments, min/max, one exact percentile array per
column, ...); only the bases of the requested features enter the plan, so a
full statistical profile is one scan plus at most two small follow-up passes
(MAD, trimmed mean) that use one-row fits as literals.
"""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, unpivot, union_all, empty_long, collect_bounded
from ..functions.numeric import safe_div
from ..functions.normality import anderson_critical, rank_statistics, shapiro_pvalue
from ..functions.orderstats import group_quantiles, quantiles_of_keys, ranged_counts, ranks_of_keys, value_counts, weighted_counts
from . import gram
from . import moments as M

NAN = float("nan")
QS = [0.25, 0.5, 0.75]


def _x(c: str) -> Column:
    return F.col(c).cast("double")


# base aggregate name -> builder over one column
BASES: dict[str, Callable[[str, bool], Column]] = {
    "n": lambda c, ex: F.count(_x(c)).cast("double"),
    "mean": lambda c, ex: F.avg(_x(c)),
    "var": lambda c, ex: F.var_samp(_x(c)),
    "skew": lambda c, ex: F.skewness(_x(c)),
    "kurt": lambda c, ex: F.kurtosis(_x(c)),
    "min": lambda c, ex: F.min(_x(c)),
    "max": lambda c, ex: F.max(_x(c)),
    # exact quartiles go by distributed ranks
    "q": lambda c, ex: F.percentile_approx(_x(c), QS, 100000).cast("array<double>"),
    "lnmean": lambda c, ex: F.avg(F.ln(F.when(_x(c) > 0, _x(c)))),
    "invsum": lambda c, ex: F.sum(F.try_divide(F.lit(1.0), _x(c))),
}


def counted_values(fr: Frame) -> DataFrame:
    """(attr, value, n, _pid): the values of every numeric column counted and
    written in value order, once per Frame.  Quartiles, median deviations and
    trimmed means read these counts, not the rows."""
    return fr.memo("counted_values", lambda: ranged_counts(value_counts(fr.df, {c: _x(c) for c in fr.num}), ["attr"]))


def column_quantiles(fr: Frame, cols: list[str], qs: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of some numeric columns; None for a column without values."""
    at = {c: i for i, c in enumerate(fr.num)}
    if not set(cols) <= set(at):
        fr, at = fr.with_df(fr.df, num=tuple(cols)), {c: i for i, c in enumerate(cols)}
    found = fr.memo(("quantiles", tuple(qs)), lambda: quantiles_of_keys(counted_values(fr), ["attr"], qs))
    return {c: found.get((at[c],)) for c in cols}


def _b(name: str, i: int) -> Column:
    return F.col(f"b_{name}_{i}")


def _kurt3(i):
    n = _b("n", i)
    return (_b("kurt", i) + 3.0) * F.pow(1.0 - 1.0 / n, 2.0) - 3.0


def _skew3(i):
    n = _b("n", i)
    return _b("skew", i) * F.pow((n - 1.0) / n, 1.5)


def _g_mean(i, eps=1e-10):
    mn = _b("min", i)
    return (F.when(mn < 0, F.lit(NAN)).when(mn < eps, F.lit(0.0))
            .otherwise(F.exp(_b("lnmean", i))))


def _h_mean(i):
    mn = _b("min", i)
    return (F.when(mn < 0, F.lit(NAN)).when(mn == 0, F.lit(0.0))
            .otherwise(_b("n", i) / _b("invsum", i)))


# feature -> (bases, expression over bases of column i)
COLUMN_FEATURES: dict[str, tuple[tuple[str, ...], Callable[[int], Column]]] = {
    "g_mean": (("min", "lnmean"), _g_mean),
    "h_mean": (("min", "n", "invsum"), _h_mean),
    "iq_range": (("q",), lambda i: _b("q", i)[2] - _b("q", i)[0]),
    "kurtosis": (("kurt", "n"), _kurt3),
    "max": (("max",), lambda i: _b("max", i)),
    "mean": (("mean",), lambda i: _b("mean", i)),
    "median": (("q",), lambda i: _b("q", i)[1]),
    "min": (("min",), lambda i: _b("min", i)),
    "range": (("min", "max"), lambda i: _b("max", i) - _b("min", i)),
    "sd": (("var",), lambda i: F.sqrt(_b("var", i))),
    "skewness": (("skew", "n"), _skew3),
    "var": (("var",), lambda i: _b("var", i)),
}


def column_bases(fr: Frame, features, cols=None, exact: bool = True, by_class: bool = False) -> DataFrame:
    cols = list(cols if cols is not None else fr.num)
    need = sorted({b for f in features for b in COLUMN_FEATURES[f][0]})
    aggs = [BASES[b](c, exact).alias(f"b_{b}_{i}") for i, c in enumerate(cols) for b in need]
    if not exact or (by_class and "q" not in need):
        return fr.df.groupBy(fr.y().alias("_cls")).agg(*aggs) if by_class else fr.df.agg(*aggs)
    # exact quartiles by distributed ranks, beside the one aggregate of the rest
    rest = [BASES[b](c, exact).alias(f"b_{b}_{i}") for i, c in enumerate(cols) for b in need if b != "q"]
    if by_class:
        q = group_quantiles(fr.df, {f"b_q_{i}": _x(c) for i, c in enumerate(cols)}, fr.y(), QS)
        rows = fr.df.groupBy(fr.y().alias("_cls")).agg(F.count(F.lit(1)).alias("b_rows"), *rest)
        return rows.join(q, F.col("_cls").eqNullSafe(F.col("grp")), "left").drop("grp")
    return _counted_bases(fr, cols, need)


def _counted_bases(fr: Frame, cols: list[str], need: list[str]) -> DataFrame:
    """The bases of whole columns, one row, from the counted values: a few
    expressions grouped by column instead of some for each column over the rows."""
    q = column_quantiles(fr, cols, QS) if "q" in need else {}
    at = {c: i for i, c in enumerate(fr.num)}
    if not set(cols) <= set(at):
        fr, at = fr.with_df(fr.df, num=tuple(cols)), {c: i for i, c in enumerate(cols)}
    found = fr.memo("counted_moments", lambda: {r["attr"]: r for r in _moments_of_counts(counted_values(fr)).collect()})  # a row a column
    bases = []
    for i, c in enumerate(cols):
        r = found.get(at[c])
        for b in need:
            if b == "q":
                v = F.array(*[F.lit(float(x)) for x in q[c]]) if q[c] else F.lit(None).cast("array<double>")
            else:
                v = F.lit(r[b] if r else (0.0 if b == "n" else None)).cast("double")
            bases.append(v.alias(f"b_{b}_{i}"))
    return fr.spark.range(1).select(F.lit(float(fr.count())).alias("b_rows"), *bases)


def _moments_of_counts(counts: DataFrame) -> DataFrame:
    """(attr, base ...) of counted values (attr, value, n), like Spark's own
    aggregates of the rows: no skewness or kurtosis of a constant column."""
    x, n = F.col("value"), F.col("n").cast("double")
    first = counts.groupBy("attr").agg(
        F.sum(n).alias("n_"), (F.sum(n * x) / F.sum(n)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.try_divide(F.sum(F.when(x > 0, n * F.ln(F.when(x > 0, x)))), F.sum(F.when(x > 0, n))).alias("lnmean"),
        F.sum(F.try_divide(n, x)).alias("invsum"))
    d = x - F.col("mean")
    powers = counts.join(F.broadcast(first.select("attr", "mean")), "attr").groupBy("attr").agg(  # a row a column
        *[F.sum(n * F.pow(d, F.lit(float(p)))).alias(f"m{p}") for p in (2, 3, 4)])
    varies = F.col("min") != F.col("max")
    m2 = F.when(varies, F.col("m2")).otherwise(F.lit(0.0))
    one = F.col("n_")
    return first.join(powers, "attr").select(
        "attr", one.alias("n"), "mean", "min", "max", "lnmean", "invsum",
        F.when(one > 1, m2 / (one - 1)).alias("var"),
        F.when(varies, F.sqrt(one) * F.try_divide(F.col("m3"), F.pow(m2, F.lit(1.5)))).alias("skew"),
        F.when(varies, one * F.try_divide(F.col("m4"), m2 * m2) - 3.0).alias("kurt"))


def column_features(fr: Frame, features=None, cols=None, exact: bool = True,
                    by_class: bool = False) -> DataFrame:
    """All requested per-column features in one aggregate, long form."""
    features = list(features or COLUMN_FEATURES)
    cols = list(cols if cols is not None else fr.num)
    if not cols:
        return empty_long(fr.spark)
    bases = column_bases(fr, features, cols, exact, by_class)
    cls = F.col("_cls") if by_class else None
    entries = [entry(f, COLUMN_FEATURES[f][1](i), attr=c, cls=cls, idx=i)
               for f in features for i, c in enumerate(cols)]
    return unpivot(bases, entries)


def _single(name):
    def ft(fr: Frame, exact: bool = True) -> DataFrame:
        return column_features(fr, [name], exact=exact)
    ft.__name__ = f"ft_{name}"
    return ft


ft_g_mean = _single("g_mean")
ft_h_mean = _single("h_mean")
ft_iq_range = _single("iq_range")
ft_kurtosis = _single("kurtosis")
ft_max = _single("max")
ft_mean = _single("mean")
ft_median = _single("median")
ft_min = _single("min")
ft_range = _single("range")
ft_sd = _single("sd")
ft_skewness = _single("skewness")
ft_var = _single("var")


def ft_mad(fr: Frame, factor: float = 1.4826) -> DataFrame:
    """median(|x - median(x)|) * factor; the medians are a one-row fit."""
    cols = list(fr.num)
    q = column_quantiles(fr, cols, QS)
    med = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        if q[c]:
            med = F.when(F.col("attr") == i, F.lit(float(q[c][1]))).otherwise(med)
    apart = weighted_counts(counted_values(fr), F.abs(F.col("value") - med))
    found = quantiles_of_keys(ranged_counts(apart, ["attr"]), ["attr"], [0.5])
    dev = {c: found.get((i,)) for i, c in enumerate(cols)}
    return unpivot(fr.spark.range(1), [entry("mad", F.lit(dev[c][0] * factor if dev.get(c) else None), attr=c, idx=i)
                                       for i, c in enumerate(cols)])


def ft_t_mean(fr: Frame, pcut: float = 0.2) -> DataFrame:
    """Trimmed mean: cut int(pcut*n) values at each end of the sorted column.

    The two boundary values come from distributed ranks, then one pass sums the values strictly between them and adds the boundary values as
    many times as they fall inside the kept range.
    """
    cols = list(fr.num)
    counts = counted_values(fr)
    n_of = {r["attr"]: r["n"] for r in counts.groupBy("attr").agg(F.sum("n").alias("n")).collect()}  # a row a column
    bounds = []
    for i in range(len(cols)):
        n = n_of.get(i, 0)
        lc = int(pcut * n)
        bounds.append((n, lc, n - lc))
    cut = lambda n: (int(pcut * n), n - int(pcut * n) - 1)
    found = ranks_of_keys(counts, ["attr"], lambda n: cut(n) if cut(n)[1] >= cut(n)[0] else ())
    az = {}
    for i, c in enumerate(cols):
        az[f"a{i}"], az[f"z{i}"] = (found.get((i,), {}).get(r) for r in cut(bounds[i][0]))
    sums = []
    x, n = F.col("value"), F.col("n")
    for i, c in enumerate(cols):
        a, z = az[f"a{i}"], az[f"z{i}"]
        own = F.col("attr") == i
        if a is None:
            sums += [F.lit(None).cast("double").alias(f"s{i}"), F.lit(0).alias(f"la{i}"),
                     F.lit(0).alias(f"le{i}"), F.lit(0).alias(f"lz{i}")]
            continue
        sums.append(F.sum(F.when(own & (x > a) & (x < z), x * n)).alias(f"s{i}"))
        for name, inside in (("la", x < a), ("le", x <= a), ("lz", x < z)):
            sums.append(F.coalesce(F.sum(F.when(own & inside, n)), F.lit(0)).alias(f"{name}{i}"))
    agg = counts.agg(F.count(F.lit(1)).alias("cells"), *sums)
    entries = []
    for i, c in enumerate(cols):
        n, lc, uc = bounds[i]
        a, z = az[f"a{i}"], az[f"z{i}"]
        if a is None:
            entries.append(entry("t_mean", F.lit(None).cast("double"), attr=c, idx=i))
            continue
        kept = float(uc - lc)
        if a == z:
            val = F.lit(float(a))
        else:
            na = F.least(F.col(f"le{i}"), F.lit(uc)) - F.lit(lc)
            nz = F.lit(uc) - F.greatest(F.col(f"lz{i}"), F.lit(lc))
            val = (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + na * F.lit(float(a)) + nz * F.lit(float(z))) / kept
        entries.append(entry("t_mean", val, attr=c, idx=i))
    return unpivot(agg, entries)


def _lower_pairs(cols):
    """(i, j) with i > j in row-major order, as numpy's tril_indices(k=-1)."""
    return [(i, j) for i in range(len(cols)) for j in range(i)]


def _corr(a: Column, b: Column) -> Column:
    """Correlation over the rows that have both; null where either is constant."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_samp(a, b), F.sqrt(F.var_samp(F.when(both, a)) * F.var_samp(F.when(both, b))))


def _pair_feature(fr: Frame, name: str, agg_fn, blocked: bool | None = None, size: int = gram.TILE) -> DataFrame:
    """Absolute values of all column pairs.  ``blocked``: by the blocked kernel
    rather than by an expression a pair; None takes it beyond
    ``moments.MAX_PAIRWISE_COLS`` columns."""
    cols = list(fr.num)
    if len(cols) < 2:
        return empty_long(fr.spark)
    if blocked or (blocked is None and len(cols) > M.MAX_PAIRWISE_COLS):
        names = F.array(*[F.lit(c) for c in cols])
        i, j = F.col("i"), F.col("j")
        at = entry(name, F.abs(F.col("value")), attr=F.concat_ws("|", names[i], names[j]),
                   idx=(i.cast("long") * (i - 1) / 2).cast("int") + j)
        return gram.pair_values(fr.df, cols, name, size).select(F.inline(F.array(at)))
    pairs = _lower_pairs(cols)
    r = fr.df.agg(*[agg_fn(_x(cols[i]), _x(cols[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
    return unpivot(r, [entry(name, F.abs(F.col(f"p{k}")), attr=f"{cols[i]}|{cols[j]}", idx=k)
                       for k, (i, j) in enumerate(pairs)])


def ft_cor(fr: Frame, blocked: bool | None = None, size: int = gram.TILE) -> DataFrame:
    return _pair_feature(fr, "cor", _corr, blocked, size)


def ft_cov(fr: Frame, blocked: bool | None = None, size: int = gram.TILE) -> DataFrame:
    return _pair_feature(fr, "cov", F.covar_samp, blocked, size)


def ft_nr_cor_attr(fr: Frame, threshold: float = 0.5, normalize: bool = True) -> DataFrame:
    cols = list(fr.num)
    pairs = _lower_pairs(cols)
    d = len(cols)
    norm = 2.0 / (d * (d - 1.0)) if normalize and d > 1 else 1.0
    if not pairs:
        return unpivot(fr.df.agg(F.count(F.lit(1))), [entry("nr_cor_attr", F.lit(NAN))])
    if d > M.MAX_PAIRWISE_COLS:
        r = gram.pair_values(fr.df, cols, "cor").agg(F.count_if(F.abs(F.col("value")) >= threshold).alias("hits"))
        return unpivot(r, [entry("nr_cor_attr", F.col("hits") * norm)])
    r = fr.df.agg(*[_corr(_x(cols[i]), _x(cols[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
    hits = sum(F.coalesce(F.abs(F.col(f"p{k}")) >= threshold, F.lit(False)).cast("double") for k in range(len(pairs)))
    return unpivot(r, [entry("nr_cor_attr", hits * norm)])


def ft_nr_outliers(fr: Frame, whis: float = 1.5, exact: bool = True) -> DataFrame:
    cols = list(fr.num)
    b = column_bases(fr, ["iq_range", "min", "max"], cols, exact)
    terms = []
    for i in range(len(cols)):
        q1, q3 = _b("q", i)[0], _b("q", i)[2]
        w = whis * (q3 - q1)
        terms.append(((q1 - w > _b("min", i)) | (q3 + w < _b("max", i))).cast("double"))
    return unpivot(b, [entry("nr_outliers", sum(terms) if terms else F.lit(0.0))])


def ft_sparsity(fr: Frame, normalize: bool = True) -> DataFrame:
    """(n / distinct - 1) / (n - 1) per raw attribute."""
    cols = list(fr.attrs)
    r = fr.df.agg(F.count(F.lit(1)).cast("double").alias("n"),
                  *[F.count_distinct(F.col(c)).cast("double").alias(f"u{i}") for i, c in enumerate(cols)])
    n = F.col("n")
    norm = (1.0 / (n - 1.0)) if normalize else F.lit(1.0)
    return unpivot(r, [entry("sparsity", (n / F.col(f"u{i}") - 1.0) * norm, attr=c, idx=i)
                       for i, c in enumerate(cols)])


def ft_gravity(fr: Frame, norm_ord: float = 2.0) -> DataFrame:
    """p-norm between the centroids of the majority and minority classes.

    Majority: largest count, smallest label on ties; minority: smallest count
    among the rest, smallest label on ties.  One groupBy pass; the class table
    has one row per class.
    """
    cols = list(fr.num)
    cent = fr.df.groupBy(fr.y().alias("cls")).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.avg(_x(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = collect_bounded(cent, "classes")  # one row per class, size checked
    rows.sort(key=lambda r: r["cls"])
    maj = max(rows, key=lambda r: (r["cnt"], -rows.index(r)))
    rest = [r for r in rows if r is not maj]
    if not rest:
        val = NAN
    else:
        mino = min(rest, key=lambda r: (r["cnt"], rest.index(r)))
        diff = np.array([maj[f"m{i}"] - mino[f"m{i}"] for i in range(len(cols))], dtype=float)
        val = float(np.linalg.norm(diff, ord=norm_ord))
    return M.values_frame(fr.spark, "gravity", [val])


def ft_eigenvalues(fr: Frame) -> DataFrame:
    cov, _ = M.covariance(fr)
    vals = np.linalg.eigvalsh(cov)
    return M.values_frame(fr.spark, "eigenvalues", vals)


def _can_eigs(fr: Frame):
    sc = M.class_scatter(fr)
    return M.discriminant_eigs(sc)


def ft_can_cor(fr: Frame) -> DataFrame:
    lam = _can_eigs(fr)
    return M.values_frame(fr.spark, "can_cor", np.sqrt(lam / (1.0 + lam)))


def ft_nr_disc(fr: Frame) -> DataFrame:
    return M.values_frame(fr.spark, "nr_disc", [float(len(_can_eigs(fr)))])


def ft_w_lambda(fr: Frame) -> DataFrame:
    lam = _can_eigs(fr)
    return M.values_frame(fr.spark, "w_lambda", [float(np.exp(-np.sum(np.log1p(lam))))])


def ft_p_trace(fr: Frame) -> DataFrame:
    lam = _can_eigs(fr)
    return M.values_frame(fr.spark, "p_trace", [float(np.sum(lam / (1.0 + lam)))])


def ft_lh_trace(fr: Frame) -> DataFrame:
    lam = _can_eigs(fr)
    return M.values_frame(fr.spark, "lh_trace", [float(np.sum(lam))])


def ft_roy_root(fr: Frame, criterion: str = "eigval") -> DataFrame:
    lam = _can_eigs(fr)
    if criterion == "eigval":
        v = float(np.max(lam)) if len(lam) else NAN
    elif criterion == "cancor":
        v = float(np.max(lam / (1.0 + lam))) if len(lam) else NAN
    else:
        raise ValueError("criterion must be 'eigval' or 'cancor'")
    return M.values_frame(fr.spark, "roy_root", [v])


def ft_sd_ratio(fr: Frame, reference_flip: bool = False) -> DataFrame:
    """Box's M homogeneity of the class covariance matrices.

    ``reference_flip`` reproduces a class/row axis flip of the original
    formulation (weights pair with the reversed class list and the matrices
    are transposed in their first two axes).
    """
    return M.values_frame(fr.spark, "sd_ratio", [M.box_m(M.class_scatter(fr), reference_flip)])


NORMALITY = ("dagostino-pearson", "shapiro-wilk", "anderson-darling")


def ft_nr_norm(fr: Frame, method: str = "dagostino-pearson", threshold: float = 0.05, failure: str = "soft") -> DataFrame:
    """Columns that pass a normality test, over all rows.

    ``dagostino-pearson`` needs only n, skewness and kurtosis of each column,
    one aggregate; the other two are rank-weighted sums (``functions.normality``).
    ``all``: any test (``failure="soft"``) or every test (``"hard"``) must be
    passed.  A column on which a test has no value does not pass it.
    """
    if method not in (*NORMALITY, "all"):
        raise ValueError(f"method must be one of {(*NORMALITY, 'all')}")
    if failure not in ("soft", "hard"):
        raise ValueError("failure must be 'soft' or 'hard'")
    cols = list(fr.num)
    tests = NORMALITY if method == "all" else (method,)
    verdicts = []
    if "dagostino-pearson" in tests:
        r = column_bases(fr, ["skewness", "kurtosis"], cols).first()
        ps = [k2_pvalue(float(r[f"b_n_{i}"]), r[f"b_skew_{i}"], r[f"b_kurt_{i}"]) for i in range(len(cols))]
        verdicts.append([p is not None and p > threshold for p in ps])
    if len(tests) > 1 or method != "dagostino-pearson":
        found = normality_statistics(fr)
        if "shapiro-wilk" in tests:
            verdicts.append([found[c]["w"] is not None and shapiro_pvalue(found[c]["w"], found[c]["n"]) > threshold for c in cols])
        if "anderson-darling" in tests:
            verdicts.append([found[c]["a2"] is not None and found[c]["a2"] <= anderson_critical(found[c]["n"], threshold) for c in cols])
    decide = any if failure == "soft" else all
    return M.values_frame(fr.spark, "nr_norm", [float(sum(decide(v) for v in zip(*verdicts)))])


def normality_statistics(fr: Frame) -> dict[str, dict]:
    """{column: {n, w, a2}}, once per Frame."""
    return fr.memo("normality", lambda: rank_statistics(fr.df, {c: _x(c) for c in fr.num}))


def k2_pvalue(n: float, g1, g2):
    """p-value of the K^2 omnibus test (skewness z and kurtosis z, chi2(2))."""
    if g1 is None or g2 is None or n < 8 or math.isnan(g1) or math.isnan(g2):
        return None
    y = g1 * math.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + math.sqrt(2.0 * (beta2 - 1.0))
    delta = 1.0 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1.0))
    ya = (1.0 if y == 0 else y) / alpha
    zs = delta * math.log(ya + math.sqrt(ya * ya + 1.0))
    b2 = g2 + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    xk = (b2 - e) / math.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(
        (6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + math.sqrt(1.0 + 4.0 / (sb1 * sb1)))
    term1 = 1.0 - 2.0 / (9.0 * a)
    denom = 1.0 + xk * math.sqrt(2.0 / (a - 4.0))
    if denom == 0:
        return None
    term2 = math.copysign(abs((1.0 - 2.0 / a) / denom) ** (1.0 / 3.0), denom)
    zk = (term1 - term2) / math.sqrt(2.0 / (9.0 * a))
    return math.exp(-(zs * zs + zk * zk) / 2.0)


FEATURES = {
    **{name: _single(name) for name in COLUMN_FEATURES},
    "can_cor": ft_can_cor, "cor": ft_cor, "cov": ft_cov, "eigenvalues": ft_eigenvalues,
    "gravity": ft_gravity, "lh_trace": ft_lh_trace, "mad": ft_mad, "nr_cor_attr": ft_nr_cor_attr,
    "nr_disc": ft_nr_disc, "nr_norm": ft_nr_norm, "nr_outliers": ft_nr_outliers,
    "p_trace": ft_p_trace, "roy_root": ft_roy_root, "sd_ratio": ft_sd_ratio,
    "sparsity": ft_sparsity, "t_mean": ft_t_mean, "w_lambda": ft_w_lambda,
}
NEEDS_LABEL = {"can_cor", "gravity", "lh_trace", "nr_disc", "p_trace", "roy_root", "sd_ratio", "w_lambda"}
