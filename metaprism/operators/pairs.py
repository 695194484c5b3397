"""Pair kernel: exact all-pairs distance statistics without materialising pairs.

Rows are hashed into ``B`` blocks (B grows with the row count so a block
holds about ``block_rows`` rows).  Every row is replicated to the B tiles
``(min(b, o), max(b, o))`` that involve its block, each tile is one group of
``applyInPandas`` that builds the (block x block) distance tile in numpy and
returns only PER-ROW partial statistics (class-wise sums/min/max/counts,
nearest neighbour, nearest enemy, optional threshold counts, concept weights,
top-k).  A final ``groupBy(row_id)`` merges the B partials of every row.

Work is O(n^2) (inherent to these features), memory per task is one tile,
output is O(n * B) partial rows - never the n^2 pairs.  Skew cannot build up:
tiles are formed by a hash of the row key, not by class or value.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, NotComputable, keyed

MAX_CLASSES = 256
BLOCK_ROWS = 2048
#: Class-wise sums, bounds and counts; squares; nearest row of the own class, of any, of another.
STATS = ("classes", "sumsq", "own", "nn", "ne")


def scaled_matrix(fr: Frame, scale: str | None) -> DataFrame:
    """(row_id, y, x array<double>) with optional min-max scaling (one fit)."""
    cols = list(fr.num)
    xs = [F.col(c).cast("double") for c in cols]
    if scale == "minmax":
        r = fr.df.agg(*[F.min(x).alias(f"a{i}") for i, x in enumerate(xs)],
                      *[F.max(x).alias(f"b{i}") for i, x in enumerate(xs)]).first()
        xs = [(x - F.lit(r[f"a{i}"])) / F.lit((r[f"b{i}"] - r[f"a{i}"]) or 1.0) for i, x in enumerate(xs)]
    elif scale is not None:
        raise ValueError(scale)
    fr = keyed(fr, integral=True)
    return fr.df.select(F.col(fr.row_id).cast("long").alias("row_id"), fr.y().alias("y"), F.array(*xs).alias("x"))


def _dist(A: np.ndarray, B: np.ndarray, metric: str) -> np.ndarray:
    """Distances by direct differences, summed column by column: no
    cancellation, and never more than two tiles in memory."""
    if metric not in ("euclidean", "gower", "manhattan"):
        raise ValueError(metric)
    total = np.zeros((A.shape[0], B.shape[0]))
    for j in range(A.shape[1]):
        diff = A[:, j][:, None] - B[:, j][None, :]
        total += diff * diff if metric == "euclidean" else np.abs(diff)
    if metric == "euclidean":
        return np.sqrt(total)
    return total / A.shape[1] if metric == "gower" else total  # gower: mean difference of min-max scaled columns


def _stats_schema(k: int, opts: dict) -> T.StructType:
    want = opts["want"]
    f = [T.StructField("row_id", T.LongType()), T.StructField("y", T.StringType())]
    for c in range(k if "classes" in want else 0):
        f += [T.StructField(f"s{c}", T.DoubleType()), T.StructField(f"mn{c}", T.DoubleType()),
              T.StructField(f"mx{c}", T.DoubleType()), T.StructField(f"n{c}", T.LongType())]
    if "sumsq" in want:
        f += [T.StructField("sumsq", T.DoubleType())]
    if "own" in want:
        f += [T.StructField("own_d", T.DoubleType())]
    if "nn" in want:
        f += [T.StructField("nn_d", T.DoubleType()), T.StructField("nn_id", T.LongType()), T.StructField("nn_y", T.StringType())]
    if "ne" in want:
        f += [T.StructField("ne_d", T.DoubleType()), T.StructField("ne_id", T.LongType())]
    if opts.get("thresh"):
        f += [T.StructField("below", T.LongType())]
    if opts.get("spheres"):
        f += [T.StructField(n, T.LongType()) for n in ("c_act_before", "c_und_before", "c_act_any")]
    if opts.get("eps") is not None:
        f += [T.StructField("n_eps", T.LongType()), T.StructField("lab_min", T.LongType())]
    if opts.get("knng"):
        f += [T.StructField("knn_out", T.LongType()), T.StructField("knn_mutual", T.LongType())]
    if opts.get("concept"):
        f += [T.StructField(n, T.DoubleType()) for n in ("w_other", "w_all", "w_d", "imp_other", "imp_all")]
    if opts.get("topk"):
        f += [T.StructField("topk", T.ArrayType(T.StructType([
            T.StructField("d", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("y", T.StringType())])))]
    return T.StructType(f)


def _tile_fn(classes: list[str], metric: str, opts: dict):
    cidx = {c: i for i, c in enumerate(classes)}
    k = len(classes)
    topk = opts.get("topk") or 0
    concept = opts.get("concept")
    want = opts["want"]

    def concept_weights(D, self_mask):
        if not concept:
            return None
        alpha, minimum, ncol, imp_alpha = concept
        div = math.sqrt(ncol) - D
        div = np.where(div <= 0, minimum, div)
        w, wi = np.exp2(-alpha * (D / div)), np.exp2(-imp_alpha * np.maximum(np.ceil(D), 1.0))
        if self_mask is not None:
            w[self_mask], wi[self_mask] = 0.0, 0.0
        return w, wi

    def side_stats(ids, ys, yc, D, other_ids, other_ys, other_yc, self_mask, thr, grp=None, other_grp=None,
                   sph=None, other_sph=None, lab=None, other_lab=None, kg=None, other_kg=None,
                   weights=None, code=None, other_code=None):
        """Statistics for the rows of D (axis 0) over the columns of D.

        With groups (e.g. CV folds), row i only sees rows of OTHER groups, so
        one kernel pass serves every fold's train/test split at once."""
        n = D.shape[0]
        out = {"row_id": ids, "y": ys}
        # None: all pairs of the tile count, as in most tiles
        valid = None if self_mask is None else ~self_mask
        if grp is not None:
            other_group = grp[:, None] != other_grp[None, :]
            valid = other_group if valid is None else valid & other_group

        def kept(mask):
            return mask if valid is None else valid & mask

        def least(mask):
            return D if mask is None else np.where(mask, D, np.inf)
        if "classes" in want:
            # the columns of a class together: one pass over the tile for all classes
            for c in range(k):
                mine = np.flatnonzero(other_yc == c)
                Dc, vc = D[:, mine], None if valid is None else valid[:, mine]
                out[f"s{c}"] = (Dc if vc is None else np.where(vc, Dc, 0.0)).sum(1)
                out[f"mn{c}"] = (Dc if vc is None else np.where(vc, Dc, np.inf)).min(1, initial=np.inf)
                out[f"mx{c}"] = (Dc if vc is None else np.where(vc, Dc, -np.inf)).max(1, initial=-np.inf)
                out[f"n{c}"] = np.full(n, len(mine), dtype="int64") if vc is None else vc.sum(1).astype("int64")
        if "sumsq" in want:
            Dv = D if valid is None else np.where(valid, D, 0.0)
            out["sumsq"] = (Dv * Dv).sum(1)
        if "own" in want:
            own = least(kept(other_yc[None, :] == yc[:, None])).min(1, initial=np.inf)
            out["own_d"] = np.where(yc < 0, np.nan, own)
        # nearest neighbour and nearest enemy; columns are in id order, so the
        # first minimum has the smallest id
        def nearest(mask):
            if not D.shape[1]:
                return np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
            masked = least(mask)
            at = masked.argmin(1)
            return masked[np.arange(n), at], at, np.ones(n, dtype=bool) if mask is None else mask.any(1)

        if "nn" in want:
            out["nn_d"], first, has = nearest(valid)
            out["nn_id"] = np.where(has, other_ids[first], -1) if D.shape[1] else np.full(n, -1)
            out["nn_y"] = np.where(has, other_ys[first], None) if D.shape[1] else np.full(n, None)
        if "ne" in want:
            enemy = kept(other_code[None, :] != code[:, None])
            if opts.get("positive"):
                enemy = enemy & (D > 0)  # zero distance is no edge
            out["ne_d"], fe, has_e = nearest(enemy)
            out["ne_id"] = np.where(has_e, other_ids[fe], -1) if D.shape[1] else np.full(n, -1)
        if thr is not None:
            le = opts.get("thresh_le")
            out["below"] = np.count_nonzero(kept((D <= thr[:, None]) if le else (D < thr[:, None])), axis=1).astype("int64")
        if lab is not None:
            # density clustering: neighbours within eps, smallest label of
            # core neighbours within eps
            near = kept(D <= opts["eps"])
            o_lab, o_core = other_lab
            out["n_eps"] = near.sum(1).astype("int64")
            big = np.iinfo(np.int64).max
            cand = np.where(near & (o_core == 1)[None, :], o_lab[None, :], big)
            out["lab_min"] = cand.min(1) if cand.shape[1] else np.full(n, big)
        if kg is not None:
            # k-NN graph restricted to same-class, positive-distance pairs:
            # j is among i's k nearest iff (d, id_j) <= (kth_d_i, kth_id_i)
            (rkd_i, rki_i), (rkd_j, rki_j) = kg, other_kg
            in_i = (D < rkd_i[:, None]) | ((D == rkd_i[:, None]) & (other_ids[None, :] <= rki_i[:, None]))
            in_j = (D < rkd_j[None, :]) | ((D == rkd_j[None, :]) & (ids[:, None] <= rki_j[None, :]))
            same = kept(other_code[None, :] == code[:, None]) & (D > 0)
            out["knn_out"] = (same & in_i).sum(1).astype("int64")
            out["knn_mutual"] = (same & in_i & in_j).sum(1).astype("int64")
        if sph is not None:
            # hyperspheres: other row j contains row i when D[i, j] <= r_j
            (_, o_i, _), (r_j, o_j, s_j) = sph, other_sph
            inside = kept(D <= r_j[None, :])
            before = inside & (o_j[None, :] < o_i[:, None])
            out["c_act_before"] = (before & (s_j == 1)[None, :]).sum(1).astype("int64")
            out["c_und_before"] = (before & (s_j == 0)[None, :]).sum(1).astype("int64")
            out["c_act_any"] = (inside & (s_j == 1)[None, :]).sum(1).astype("int64")
        if concept:
            # the weights go both ways, so a tile has them once for its two sides
            w, wi = weights
            # by class of the other row: sums over the classes that are not the row's own
            level, at = np.unique(other_yc, return_inverse=True)
            of = (at[:, None] == np.arange(len(level))[None, :]).astype(float)
            others = (level[None, :] != yc[:, None]).astype(float)
            by, by_i = w @ of, wi @ of
            out["w_other"], out["w_all"] = (by * others).sum(1), by.sum(1)
            out["w_d"] = np.einsum("ij,ij->i", w, D)
            out["imp_other"], out["imp_all"] = (by_i * others).sum(1), by_i.sum(1)
        if topk:
            Dk = least(valid)
            o = np.argsort(Dk, axis=1, kind="stable")[:, :topk]
            lists = []
            for r in range(n):
                lst = [{"d": float(Dk[r, j]), "id": int(other_ids[j]), "y": other_ys[j]} for j in o[r] if np.isfinite(Dk[r, j])]
                lists.append(lst)
            out["topk"] = lists
        return pd.DataFrame(out)

    def fn(key, pdf):
        ta, tb = int(key[0]), int(key[1])
        pdf = pdf.sort_values("row_id", ignore_index=True)
        X = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
        ids = pdf["row_id"].to_numpy()
        ys = pdf["y"].to_numpy(dtype=object)
        yc = np.array([cidx.get(v, -1) for v in ys])
        code = pd.factorize(ys, use_na_sentinel=False)[0]  # equal labels, those of no class among them
        blk = pdf["_blk"].to_numpy()
        thr = pdf["thresh"].to_numpy(dtype=float) if opts.get("thresh") else None
        g = pdf["grp"].to_numpy() if opts.get("grp") else None
        sp = ((pdf["r"].to_numpy(dtype=float), pdf["ord"].to_numpy(), pdf["st"].to_numpy())
              if opts.get("spheres") else None)

        lb = ((pdf["lab"].to_numpy(dtype="int64"), pdf["core"].to_numpy(dtype="int64"))
              if opts.get("eps") is not None else None)
        kg = ((pdf["rkd"].to_numpy(dtype=float), pdf["rkid"].to_numpy(dtype="int64"))
              if opts.get("knng") else None)

        def cutk(sel):
            return None if kg is None else tuple(x[sel] for x in kg)

        def cut(sel):
            return None if sp is None else tuple(x[sel] for x in sp)

        def cutl(sel):
            return None if lb is None else tuple(x[sel] for x in lb)
        if ta == tb:
            D = _dist(X, X, metric)
            own = np.eye(len(ids), dtype=bool)
            return side_stats(ids, ys, yc, D, ids, ys, yc, own, thr, g, g, sp, sp, lb, lb, kg, kg, concept_weights(D, own), code, code)
        a, b = blk == ta, blk == tb
        D = _dist(X[a], X[b], metric)
        w = concept_weights(D, None)
        sa = side_stats(ids[a], ys[a], yc[a], D, ids[b], ys[b], yc[b], None,
                        None if thr is None else thr[a], None if g is None else g[a], None if g is None else g[b],
                        cut(a), cut(b), cutl(a), cutl(b), cutk(a), cutk(b), w, code[a], code[b])
        sb = side_stats(ids[b], ys[b], yc[b], D.T, ids[a], ys[a], yc[a], None,
                        None if thr is None else thr[b], None if g is None else g[b], None if g is None else g[a],
                        cut(b), cut(a), cutl(b), cutl(a), cutk(b), cutk(a), None if w is None else tuple(x.T for x in w), code[b], code[a])
        return pd.concat([sa, sb], ignore_index=True)
    return fn


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys``, of which there are so many groups, to enough
    tasks for all cores: a tile takes long for its few bytes, by which adaptive
    plans would merge tiles into a few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(int(max(1, min(groups, 8 * cores))), *keys)


def tiled(mat: DataFrame, blocks: int) -> DataFrame:
    """``mat`` dealt to ``blocks`` blocks by a hash of the row (``_blk``), every
    row once for each tile (``_ta``, ``_tb``) that its block takes part in."""
    return (mat.withColumn("_blk", F.pmod(F.xxhash64(F.col("row_id"), F.lit(17)), F.lit(blocks)))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumn("_ta", F.least("_blk", "_o")).withColumn("_tb", F.greatest("_blk", "_o"))
            .drop("_o"))


def pair_stats(mat: DataFrame, classes: list[str], metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
               thresh: DataFrame | None = None, concept: tuple | None = None, topk: int = 0,
               n: int | None = None, positive: bool = False, thresh_le: bool = False,
               eps: float | None = None, want: Iterable[str] = STATS) -> DataFrame:
    """Merged per-row statistics over all other rows (see module doc); ``want``
    says which of ``STATS`` are needed.

    ``mat``: (row_id, y, x).  ``thresh``: optional (row_id, thresh) - count of
    other rows closer than the row's threshold.  Returns one row per row_id.
    """
    if len(classes) > MAX_CLASSES:
        raise NotComputable(f"{len(classes)} classes exceed {MAX_CLASSES} for class-wise pair statistics")
    n = n if n is not None else mat.count()
    B = max(1, math.ceil(n / block_rows))
    opts = {"thresh": thresh is not None, "concept": concept, "topk": topk, "grp": "grp" in mat.columns,
            "positive": positive, "thresh_le": thresh_le, "spheres": "st" in mat.columns, "eps": eps,
            "knng": "rkd" in mat.columns, "want": frozenset(want)}
    m = mat
    if thresh is not None:
        m = m.join(thresh, "row_id")
    else:
        m = m.withColumn("thresh", F.lit(None).cast("double"))
    rep = tiled(m, B)
    k = len(classes)
    schema = _stats_schema(k, opts)
    part = spread(rep, B * (B + 1) // 2, "_ta", "_tb").groupBy("_ta", "_tb").applyInPandas(_tile_fn(classes, metric, opts), schema)
    aggs = []
    for c in range(k if "classes" in opts["want"] else 0):
        aggs += [F.sum(f"s{c}").alias(f"s{c}"), F.min(f"mn{c}").alias(f"mn{c}"),
                 F.max(f"mx{c}").alias(f"mx{c}"), F.sum(f"n{c}").alias(f"n{c}")]
    if "sumsq" in opts["want"]:
        aggs.append(F.sum("sumsq").alias("sumsq"))
    if "own" in opts["want"]:
        aggs.append(F.min("own_d").alias("own_d"))
    near = {"nn": ("nn_d", "nn_id", "nn_y"), "ne": ("ne_d", "ne_id")}
    near = {name: cols for name, cols in near.items() if name in opts["want"]}
    aggs += [F.min(F.struct(*cols)).alias(name) for name, cols in near.items()]
    if thresh is not None:
        aggs.append(F.sum("below").alias("below"))
    if opts["spheres"]:
        aggs += [F.sum(c).alias(c) for c in ("c_act_before", "c_und_before", "c_act_any")]
    if eps is not None:
        aggs += [F.sum("n_eps").alias("n_eps"), F.min("lab_min").alias("lab_min")]
    if opts["knng"]:
        aggs += [F.sum("knn_out").alias("knn_out"), F.sum("knn_mutual").alias("knn_mutual")]
    if concept:
        aggs += [F.sum(c).alias(c) for c in ("w_other", "w_all", "w_d", "imp_other", "imp_all")]
    if topk:
        aggs.append(F.slice(F.array_sort(F.flatten(F.collect_list("topk"))), 1, topk).alias("topk"))
    merged = part.groupBy("row_id", "y").agg(*aggs)
    return merged.select("*", *[F.col(f"{name}.{c}").alias(c) for name, cols in near.items() for c in cols]).drop(*near)


def sorted_classes(fr: Frame) -> list[str]:
    """Distinct labels, sorted; the count is checked before collecting."""
    d = fr.df.select(fr.y().alias("y")).where(F.col("y").isNotNull()).distinct()
    k = d.count()
    if k > MAX_CLASSES:
        raise NotComputable(f"{k} classes exceed {MAX_CLASSES}")
    return sorted(r["y"] for r in d.collect())
