"""Feature extraction plan: choose groups/features/summaries, compute, summarise.

``extract(fr, groups, features, summary)`` is the Spark counterpart of a
``fit(X, y).extract()`` call on a categorical and a numeric view of the table:
the requested feature functions each add a small long-form DataFrame (feature,
attr, cls, idx, value); per-column statistical features share one aggregate;
pair-kernel features share one kernel pass per (metric, scaling).  The union is summarised by one
``groupBy(feature)`` (U15) and returned as (name, value) sorted by name.
"""

from __future__ import annotations

import re
import threading
import warnings
from concurrent.futures import ThreadPoolExecutor
from typing import Iterable

import numpy as np
from pyspark import errors, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import LONG_SCHEMA, Frame, NotComputable, empty_long, keyed, union_all
from ..functions.summaries import summarise, summary_width
from ..operators import clustering, complexity, general, infotheory, itemset, statistical
from ..operators import landmarking, modelbased, resampling
from ..operators import neighbourhood as NB
from ..operators.shaping import relative_rank
from ..operators.encoding import build_C, build_N, rescale_numeric
from ..session import ensure_checkpoint_dir

DEFAULT_GROUPS = ("general", "statistical", "info-theory")
DEFAULT_SUMMARY = ("mean", "sd")

# fixed values: feature names per group (vector = summarised, scalar = bare name)
CATALOGUE: dict[str, dict[str, bool]] = {
    "general": {"attr_to_inst": False, "cat_to_num": False, "freq_class": True, "inst_to_attr": False,
                "nr_attr": False, "nr_bin": False, "nr_cat": False, "nr_class": False, "nr_inst": False,
                "nr_num": False, "num_to_cat": False},
    "statistical": {"can_cor": True, "cor": True, "cov": True, "eigenvalues": True, "g_mean": True,
                    "gravity": False, "h_mean": True, "iq_range": True, "kurtosis": True, "lh_trace": False,
                    "mad": True, "max": True, "mean": True, "median": True, "min": True, "nr_cor_attr": False,
                    "nr_disc": False, "nr_norm": False, "nr_outliers": False, "p_trace": False, "range": True,
                    "roy_root": False, "sd": True, "sd_ratio": False, "skewness": True, "sparsity": True,
                    "t_mean": True, "var": True, "w_lambda": False},
    "info-theory": {"attr_conc": True, "attr_ent": True, "class_conc": True, "class_ent": False,
                    "eq_num_attr": False, "joint_ent": True, "mut_inf": True, "ns_ratio": False},
    "itemset": {"one_itemset": True, "two_itemset": True},
    "clustering": {"ch": False, "int": False, "nre": False, "pb": False, "sc": False, "sil": False,
                   "vdb": False, "vdu": False},
    "complexity": {"c1": False, "c2": False, "cls_coef": False, "density": False, "f1": True, "f1v": True, "f2": True, "f3": True, "f4": True, "hubs": True,
                   "l1": True, "l2": True, "l3": True, "lsc": False, "n1": False, "n2": True, "n3": True,
                   "n4": True, "t1": False, "t2": False, "t3": False, "t4": False},
    "landmarking": {"best_node": True, "elite_nn": True, "linear_discr": True, "naive_bayes": True,
                    "one_nn": True, "random_node": True, "worst_node": True},
    "model-based": {"leaves": False, "leaves_branch": True, "leaves_corrob": True, "leaves_homo": True,
                    "leaves_per_class": True, "nodes": False, "nodes_per_attr": False, "nodes_per_inst": False,
                    "nodes_per_level": True, "nodes_repeated": True, "tree_depth": True, "tree_imbalance": True,
                    "tree_shape": True, "var_importance": True},
    "concept": {"cohesiveness": True, "conceptvar": True, "impconceptvar": True, "wg_dist": True},
}
CATALOGUE["relative"] = dict(CATALOGUE["landmarking"])  # ranks of the landmarkers' summaries
NEEDS_LABEL = (general.NEEDS_LABEL | statistical.NEEDS_LABEL | infotheory.NEEDS_LABEL
               | clustering.NEEDS_LABEL | complexity.NEEDS_LABEL
               | {"int", "pb", "sil", "vdu", "lsc", "n1", "n2", "n3", "n4", "t1", "density", "cls_coef", "hubs", "conceptvar", "impconceptvar"}
               | set(CATALOGUE["landmarking"]) | set(CATALOGUE["model-based"]))


def catalogue_df(spark, summaries: Iterable[str] = DEFAULT_SUMMARY) -> DataFrame:
    """(group, feature, needs_label, vector, name) expected output names."""
    rows = []
    for g, feats in CATALOGUE.items():
        for f, vec in feats.items():
            if vec:
                for s in summaries:
                    width = summary_width(s)
                    names = [f"{f}.{s}"] if width == 1 else [f"{f}.{s}.{i}" for i in range(width)]
                    if g == "relative":
                        names = [f"{n}.relative" for n in names]
                    rows += [(g, f, f in NEEDS_LABEL, vec, nm) for nm in names]
            else:
                rows.append((g, f, f in NEEDS_LABEL, vec, f))
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("feature", T.StringType()),
                           T.StructField("needs_label", T.BooleanType()), T.StructField("vector", T.BooleanType()),
                           T.StructField("name", T.StringType())])
    return spark.createDataFrame(rows, schema)


def resolve(groups="default", features="all", supervised=True) -> dict[str, list[str]]:
    """U16: expand 'default'/'all' and check names; unknown names raise."""
    if groups == "default":
        groups = DEFAULT_GROUPS
    elif groups == "all":
        groups = tuple(CATALOGUE)
    elif isinstance(groups, str):
        groups = (groups,)
    out = {}
    for g in groups:
        if g not in CATALOGUE:
            raise ValueError(f"unknown group {g!r}")
        names = list(CATALOGUE[g]) if features == "all" else [f for f in features if f in CATALOGUE[g]]
        if not supervised:
            names = [f for f in names if f not in NEEDS_LABEL]
        out[g] = names
    if features != "all":
        known = {f for fs in CATALOGUE.values() for f in fs}
        bad = [f for f in features if f not in known]
        if bad:
            raise ValueError(f"unknown features {bad}")
    return out


#: Features of many rounds or fits.
SLOW = {"hubs", "l1", "l2", "l3", "n1", "t1", "f4", "elite_nn", "linear_discr", "best_node", "worst_node", "random_node"}
#: Errors that say that a feature has no value on these data.
NOT_COMPUTABLE = (NotComputable, ArithmeticError, np.linalg.LinAlgError, errors.ArithmeticException, errors.IllegalArgumentException)
#: Feature jobs submitted at a time.
PARALLEL = 8


def _tasks(fr: Frame, plan: dict, cv: Frame, nv: Frame, block_rows: int, counted: bool) -> list:
    """(features, callable -> long DataFrame): the jobs of an extraction;
    ``counted``: two_itemset as counted values, for summaries.
    General features see the raw columns, information theory and item sets the
    categorical view, all others the numeric view."""
    shared: dict = {}

    def once(key, make):
        """A context that several features share, made by the first user."""
        lock, box = shared.setdefault(key, (threading.Lock(), []))
        with lock:
            if not box:
                box.append(make())
        return box[0]

    tasks = []
    add = lambda f, fn: tasks.append(([f], fn))
    for g, names in plan.items():
        if g == "statistical":
            one_pass = [f for f in names if f in statistical.COLUMN_FEATURES]
            if one_pass and nv.num:
                tasks.append((one_pass, lambda fs=one_pass: statistical.column_features(nv, fs)))
        elif g in ("info-theory", "itemset") and not cv.cat:
            continue
        for f in names:
            if g == "general":
                add(f, lambda f=f: general.FEATURES[f](fr))
            elif g == "statistical":
                if f not in statistical.COLUMN_FEATURES and (nv.num or f == "sparsity"):
                    add(f, lambda f=f: statistical.FEATURES[f](fr if f == "sparsity" else nv))
            elif g == "info-theory":
                uses_counts = fr.label and f in ("attr_ent", "joint_ent", "mut_inf", "eq_num_attr", "ns_ratio", "class_conc")
                add(f, lambda f=f, u=uses_counts: infotheory.FEATURES[f](
                    cv, *([once("counts", lambda: infotheory.K.attr_class_counts(cv).checkpoint(eager=True))] if u else [])))
            elif g == "itemset":
                add(f, lambda f=f: (itemset.two_itemset_counts if counted and f == "two_itemset" else itemset.FEATURES[f])(cv))
            elif g == "clustering":
                if f in clustering.FEATURES:
                    add(f, lambda f=f: clustering.FEATURES[f](nv))
                else:
                    add(f, lambda f=f: {"vdu": NB.ft_vdu, "int": NB.ft_int, "sil": NB.ft_sil, "pb": NB.ft_pb}[f](
                        once("euclidean", lambda: NB.PairContext(nv, "euclidean", None, block_rows, want=NB.CLUSTERING))))
            elif g == "complexity":
                if f in complexity.FEATURES:
                    add(f, lambda f=f: complexity.FEATURES[f](nv))
                elif f in ("n2", "n3", "lsc"):
                    add(f, lambda f=f: {"n2": NB.ft_n2, "n3": NB.ft_n3, "lsc": NB.ft_lsc}[f](
                        once("gower", lambda: NB.PairContext(nv, "gower", "minmax", block_rows, want=NB.NEIGHBOURS))))
                else:
                    add(f, lambda f=f: {"n1": NB.ft_n1, "n4": NB.ft_n4, "t1": NB.ft_t1, "density": NB.ft_density,
                                        "cls_coef": NB.ft_cls_coef, "hubs": NB.ft_hubs}[f](nv, block_rows=block_rows))
            elif g == "landmarking":
                add(f, lambda f=f: landmarking.FEATURES[f](nv))
            elif g == "model-based":
                add(f, lambda f=f: modelbased.FEATURES[f](once("tree", lambda: modelbased.TreeContext(nv))))
            elif g == "concept":
                add(f, lambda f=f: {"conceptvar": NB.ft_conceptvar, "wg_dist": NB.ft_wg_dist,
                                    "impconceptvar": NB.ft_impconceptvar, "cohesiveness": NB.ft_cohesiveness}[f](
                    once("concept", lambda: NB.concept_context(nv, block_rows=block_rows))))
    return tasks


def _plain_names(fr: Frame) -> Frame:
    """Encoded columns are called ``column[T.level]``; names without marks
    need no quoting anywhere."""
    new = {c: f"{re.sub(r'[^0-9A-Za-z_]+', '_', c)}__{i}" for i, c in enumerate(fr.num) if not c.isidentifier()}
    return fr.with_df(fr.df.withColumnsRenamed(new), num=tuple(new.get(c, c) for c in fr.num)) if new else fr


def feature_table(fr: Frame, groups="default", features="all", pair_block_rows: int = 2048,
                  transform_num: bool = True, transform_cat: str | None = "gray", rescale: str | None = None) -> DataFrame:
    """Long table of every requested feature (before summaries).

    ``transform_num`` discretises numeric columns into the categorical view,
    ``transform_cat`` ("gray", "one-hot", "one-hot-full" or None) encodes text
    columns into the numeric view, ``rescale`` scales that view.  Features are
    jobs of their own, a few at a time, each ending in the shared folder; one
    that has no value on these data (``NOT_COMPUTABLE``) gives NaN and a
    warning, and the others go on.
    """
    plan = resolve(groups, features, supervised=fr.label is not None)
    return _table(fr, plan, pair_block_rows, transform_num, transform_cat, rescale)


def _table(fr: Frame, plan: dict, pair_block_rows: int, transform_num: bool = True,
           transform_cat: str | None = "gray", rescale: str | None = None, counted: bool = False) -> DataFrame:
    """``feature_table``, or with ``counted`` and two_itemset among the features
    (feature, value, n), where a row counts n times."""
    plan = {g: names for g, names in plan.items() if names and g != "relative"}
    ensure_checkpoint_dir(fr.spark)
    uses_c = bool({"info-theory", "itemset"} & set(plan))
    uses_n = bool(set(plan) - {"general", "info-theory", "itemset"})
    cv = build_C(fr, transform_num) if uses_c else fr
    nv = _plain_names(build_N(fr, transform_cat)) if uses_n and fr.cat else fr
    if uses_n and rescale:
        nv = rescale_numeric(nv, rescale)
    counted = counted and "two_itemset" in plan.get("itemset", ())
    tasks = _tasks(fr, plan, cv, nv, pair_block_rows, counted)
    if not tasks:
        return empty_long(fr.spark)

    # the longest jobs first, so that none is left alone at the end
    order = sorted(range(len(tasks)), key=lambda i: not SLOW & set(tasks[i][0]))

    def run(i):
        names, make = tasks[i]
        try:
            return make().checkpoint(eager=True)
        except NOT_COMPUTABLE as e:  # such a feature is NaN, as a result; other errors are raised
            warnings.warn(f"{', '.join(names)}: {type(e).__name__}: {str(e)[:300]}", RuntimeWarning, stacklevel=2)
            return fr.spark.createDataFrame([(f, None, None, 0, float("nan")) for f in names], LONG_SCHEMA)

    with ThreadPoolExecutor(PARALLEL) as pool:
        parts = dict(zip(order, pool.map(inheritable_thread_target(fr.spark)(run), order)))
    tables = [parts[i] for i in range(len(tasks))]
    if counted:
        tables = [t.select("feature", "value", F.col("n") if "n" in t.columns else F.lit(1).cast("long").alias("n")) for t in tables]
    return union_all(tables)


def extract(fr: Frame, groups="default", features="all", summary=DEFAULT_SUMMARY,
            summary_args: dict | None = None, pair_block_rows: int = 2048, **views) -> DataFrame:
    """(name, value) sorted by name, like the reference's extract(); ``views``
    are the options of ``feature_table``.  The relative group ranks the
    landmarkers by each summary, which computes them if need be."""
    plan = resolve(groups, features, supervised=fr.label is not None)
    ranked, shown = plan.pop("relative", []), plan.get("landmarking", [])
    if ranked:
        plan["landmarking"] = [f for f in CATALOGUE["landmarking"] if f in {*ranked, *shown}]
    vector = {f for g, fs in plan.items() for f in fs if CATALOGUE[g][f]}
    out = summarise(_table(fr, plan, pair_block_rows, **views, counted=True), tuple(summary), vector_features=vector, args=summary_args)
    if not ranked:
        return out
    out = out.checkpoint(eager=True)
    base = F.split(F.col("name"), r"\.").getItem(0)
    hidden = [f for f in plan["landmarking"] if f not in shown]
    ranks = relative_rank(out.where(base.isin(ranked)), ranked).select("name", F.col("value").cast("double").alias("value"))
    return out.where(~base.isin(hidden) if hidden else F.lit(True)).unionByName(ranks).orderBy("name")


def extract_with_confidence(fr: Frame, groups="default", features="all", summary=DEFAULT_SUMMARY, replicates: int = 128,
                            confidence=(0.95,), seed: int = 1234, transform_cat: str | None = "gray",
                            slow_features: bool = False, **views) -> DataFrame:
    """(name, value, confidence, lower, upper): basic bootstrap intervals of
    extracted features.

    Features that moments determine (``resampling.FEATURES``) take one pass over
    the rows for all replicates.  The others asked for are left out, with a
    warning that names them, unless ``slow_features``: then each replicate is a
    table of its own, on which they are extracted, one replicate at a time.
    Every row takes part in a replicate as often as a Poisson(1) draw of its key
    says, so the number of rows varies.  Summaries are ``mean`` and ``sd``
    (``SUMMARIES`` for slow features).
    """
    plan = resolve(groups, features, supervised=fr.label is not None)
    wanted = {f for fs in plan.values() for f in fs}
    fast = [f for f in resampling.FEATURES if any(f in plan.get(g, ()) for g in ("general", "statistical"))]
    rest = [f for f in sorted(wanted) if f not in fast]
    if set(summary) - {"mean", "sd"}:
        fast, rest = [], sorted(wanted)
    fr = keyed(fr)
    table: dict = {}
    if fast:
        nv = _plain_names(build_N(fr, transform_cat)) if fr.cat else fr
        re_ = resampling.resampled(nv, replicates, seed, with_pairs=bool(resampling.NEEDS_PAIRS & set(fast)))
        for f in fast if re_.rows else ():
            values = resampling.replicate_values(re_, f)
            if any(CATALOGUE[g].get(f) for g in ("general", "statistical")):
                with np.errstate(all="ignore"):
                    for s in summary:
                        one = {"mean": lambda v: v.mean() if len(v) else np.nan, "sd": lambda v: v.std(ddof=1) if len(v) > 1 else np.nan}[s]
                        table[f"{f}.{s}"] = np.array([one(v) for v in values])
            else:
                table[f] = np.array([v[0] for v in values])
    if rest and not slow_features:
        warnings.warn(f"no intervals for {', '.join(rest)}", RuntimeWarning, stacklevel=2)
    elif rest:
        runs = []
        for r in range(replicates + 1):
            one = resampling.replicate_frame(fr, r, seed)
            got = extract(one, groups, rest, summary, transform_cat=transform_cat, **views)
            runs.append({x["name"]: x["value"] for x in got.collect()})  # one row a name
        for name in runs[0]:
            table[name] = np.array([np.nan if v.get(name) is None else v[name] for v in runs])
    rows = [(name, float(v[0]), *i) for name, v in sorted(table.items()) for i in resampling.intervals(v, confidence)]
    return fr.spark.createDataFrame(rows, "name string, value double, confidence double, lower double, upper double")


def extract_from_model(model, spark, features="all", summary=DEFAULT_SUMMARY, summary_args: dict | None = None,
                       attrs=None, classes=None) -> DataFrame:
    """(name, value) of the model-based features of a fitted decision tree
    (``TreeContext.of``), without the data it was fitted on."""
    names = resolve("model-based", features)["model-based"]
    t = modelbased.TreeContext.of(model, spark, attrs, classes)
    table = union_all([empty_long(spark), *[modelbased.FEATURES[f](t) for f in names]])
    vector = {f for f in names if CATALOGUE["model-based"][f]}
    return summarise(table, tuple(summary), vector_features=vector, args=summary_args)


def parse_by_group(results: DataFrame, groups: Iterable[str], spark=None) -> DataFrame:
    """Keep the (name, value) rows produced by features of ``groups``."""
    base = F.split(F.col("name"), r"\.").getItem(0)
    is_rank = F.col("name").endswith(".relative")
    keep = F.lit(False)
    for g in groups:
        keep = keep | (base.isin(list(CATALOGUE[g])) & (is_rank if g == "relative" else ~is_rank))
    return results.where(keep)
