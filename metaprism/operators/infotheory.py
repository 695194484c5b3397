"""Information-theoretic meta-features (I1-I8) from the contingency kernel.

All work after the kernel runs on the contingency table (levels x classes
rows), with the +epsilon smoothing of absent cells applied in closed form:
a grid of L levels by K classes with ``obs`` observed cells has
``L*K - obs`` cells of probability ``eps``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry, unpivot
from ..functions.numeric import xlog2x
from . import contingency as K

EPS = 1e-8


def _idx_map(cols):
    return F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])


def _entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """-sum p log2 p per group ``keys`` of a (keys..., cnt) table."""
    tot = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    return (counts.join(tot, keys)
            .groupBy(*keys).agg((-F.sum(xlog2x(F.col("cnt") / F.col("n")))).alias("ent")))


def attr_entropies(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    """(attr, ent)."""
    vc = K.value_counts(fr) if ct is None else ct.groupBy("attr", "value").agg(F.sum("cnt").alias("cnt"))
    return _entropy(vc, ["attr"])


def class_entropy_value(fr: Frame) -> float:
    """Entropy of the label (memoised per Frame: one grouped pass)."""
    def one_pass():
        cc = (fr.df.where(fr.y().isNotNull()).groupBy(fr.y().alias("y"))
              .agg(F.count(F.lit(1)).cast("double").alias("cnt")))
        return _entropy(cc.withColumn("g", F.lit(0)), ["g"]).first()["ent"]
    return fr.memo("class_ent", one_pass)


def joint_entropies(ct: DataFrame, eps: float = EPS) -> DataFrame:
    """(attr, ent) of the smoothed joint distribution of attr and y."""
    per = ct.groupBy("attr").agg(
        F.sum("cnt").alias("n"), F.count_distinct("value").alias("L"),
        F.count_distinct("y").alias("K"), F.count(F.lit(1)).alias("obs"))
    cells = ct.join(per, "attr").groupBy("attr", "L", "K", "obs").agg(
        F.sum(xlog2x(F.col("cnt") / F.col("n") + eps)).alias("s"))
    empty = (F.col("L") * F.col("K") - F.col("obs")).cast("double") * (eps * F.log(2.0, F.lit(eps)))
    return cells.select("attr", (-(F.col("s") + empty)).alias("ent"))


def concentration(cells: DataFrame, eps: float = EPS) -> DataFrame:
    """Concentration coefficient per group ``g`` of a (g, x, yv, cnt) table.

    conc = (sum_ij p_ij^2 / p_.j - sum_i p_i.^2) / (1 - sum_i p_i.^2) over the
    smoothed grid p_ij = cnt/n + eps.
    """
    per = cells.groupBy("g").agg(F.sum("cnt").alias("n"), F.count_distinct("x").alias("L"),
                                 F.count_distinct("yv").alias("K"))
    c = cells.join(per, "g")
    rows = c.groupBy("g", "x", "n", "K").agg(F.sum("cnt").alias("ni"))
    jsum2 = rows.groupBy("g").agg(F.sum(F.pow(F.col("ni") / F.col("n") + F.col("K") * eps, 2)).alias("jsum2"))
    colw = c.groupBy("g", "yv", "n", "L").agg(
        F.sum("cnt").alias("nj"), F.count(F.lit(1)).alias("obs_j"),
        F.sum(F.pow(F.col("cnt") / F.col("n") + eps, 2)).alias("sq"))
    s = colw.groupBy("g").agg(F.sum(
        (F.col("sq") + (F.col("L") - F.col("obs_j")) * (eps * eps))
        / (F.col("nj") / F.col("n") + F.col("L") * eps)).alias("s"))
    return s.join(jsum2, "g").select("g", ((F.col("s") - F.col("jsum2")) / (1.0 - F.col("jsum2"))).alias("conc"))


def ft_attr_ent(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    ae = attr_entropies(fr, ct)
    return ae.select(entry("attr_ent", F.col("ent"), attr=F.col("attr"), idx=_idx_map(fr.cat)[F.col("attr")]).alias("e")).select("e.*")


def ft_class_ent(fr: Frame) -> DataFrame:
    v = class_entropy_value(fr)
    return unpivot(fr.spark.range(1), [entry("class_ent", F.lit(v))])


def ft_joint_ent(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    ct = K.attr_class_counts(fr) if ct is None else ct
    je = joint_entropies(ct)
    return je.select(entry("joint_ent", F.col("ent"), attr=F.col("attr"), idx=_idx_map(fr.cat)[F.col("attr")]).alias("e")).select("e.*")


def mutual_information(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    """(attr, mi, ae) with mi = H(x) + H(y) - H(x, y)."""
    ct = K.attr_class_counts(fr) if ct is None else ct
    hy = class_entropy_value(fr)
    return (attr_entropies(fr, ct).withColumnRenamed("ent", "ae")
            .join(joint_entropies(ct).withColumnRenamed("ent", "je"), "attr")
            .select("attr", "ae", (F.col("ae") + F.lit(hy) - F.col("je")).alias("mi")))


def ft_mut_inf(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    mi = mutual_information(fr, ct)
    return mi.select(entry("mut_inf", F.col("mi"), attr=F.col("attr"), idx=_idx_map(fr.cat)[F.col("attr")]).alias("e")).select("e.*")


def ft_eq_num_attr(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    hy = class_entropy_value(fr)
    tot = mutual_information(fr, ct).agg(F.sum("mi").alias("smi"))
    return unpivot(tot, [entry("eq_num_attr", F.lit(float(len(fr.cat))) * F.lit(hy) / F.col("smi"))])


def ft_ns_ratio(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    tot = mutual_information(fr, ct).agg(F.sum("ae").alias("sae"), F.sum("mi").alias("smi"))
    return unpivot(tot, [entry("ns_ratio", (F.col("sae") - F.col("smi")) / F.col("smi"))])


def ft_class_conc(fr: Frame, ct: DataFrame | None = None) -> DataFrame:
    ct = K.attr_class_counts(fr) if ct is None else ct
    cells = ct.select(F.col("attr").alias("g"), F.col("value").alias("x"), F.col("y").alias("yv"), "cnt")
    cc = concentration(cells)
    return cc.select(entry("class_conc", F.col("conc"), attr=F.col("g"), idx=_idx_map(fr.cat)[F.col("g")]).alias("e")).select("e.*")


def ft_attr_conc(fr: Frame, max_attr_num: int | None = None) -> DataFrame:
    """Concentration of every ordered pair of distinct categorical columns.

    ``max_attr_num`` keeps the first that many columns (deterministic); by
    default every column takes part.
    """
    cols = list(fr.cat)
    if max_attr_num is not None:
        cols = cols[:max_attr_num]
    pc = K.pair_counts(fr, cols)
    fwd = pc.select(F.concat_ws("|", "a", "b").alias("g"), F.col("va").alias("x"), F.col("vb").alias("yv"), "cnt")
    bwd = pc.select(F.concat_ws("|", "b", "a").alias("g"), F.col("vb").alias("x"), F.col("va").alias("yv"), "cnt")
    cc = concentration(fwd.unionByName(bwd))
    order = [f"{a}|{b}" for a in cols for b in cols if a != b]
    return cc.select(entry("attr_conc", F.col("conc"), attr=F.col("g"), idx=_idx_map(order)[F.col("g")]).alias("e")).select("e.*")


FEATURES = {
    "attr_conc": ft_attr_conc, "attr_ent": ft_attr_ent, "class_conc": ft_class_conc,
    "class_ent": ft_class_ent, "eq_num_attr": ft_eq_num_attr, "joint_ent": ft_joint_ent,
    "mut_inf": ft_mut_inf, "ns_ratio": ft_ns_ratio,
}
NEEDS_LABEL = {"class_conc", "class_ent", "eq_num_attr", "joint_ent", "mut_inf", "ns_ratio"}
