"""Distance-based meta-features built on the pair kernel.

Clustering (label as cluster, Euclidean on N): vdu, int, sil, pb.
Complexity (Gower or Euclidean on min-max scaled N): n2, n3, lsc, nearest
enemy table.  Concept (Euclidean on min-max scaled N): conceptvar, wg_dist,
impconceptvar, cohesiveness.  k-NN table and k-NN vote.

All per-row values come from ONE kernel pass (two for lsc, which needs each
row's nearest-enemy distance as a threshold); class-level values from one
``groupBy(label)`` over the per-row table (one row per input row).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, NotComputable, empty_long, entry, keyed, union_all
from ..functions.ranking import rank_within
from . import moments as M
from ..session import written
from .cells import CELL_ROWS, Cells, Enemies, nearest_in, nearest_own, nearest_rows
from .kth import ClassBlocks, kth_neighbours, neighbour_edges, product
from .pairs import STATS, pair_stats, scaled_matrix, sorted_classes, spread, tiled, _dist

#: What the clustering features and n2, n3, lsc need of a ``PairContext``.
CLUSTERING, NEIGHBOURS = ("classes", "sumsq"), ("own", "nn", "ne")
#: Rows up to which nearest rows, enemies and spheres are found on the pair kernel, in fewer jobs; beyond, by cells.
PAIR_ROWS = 65_536
CONCEPT_DEFAULTS = (2.0, 1e-9, 1.0)  # conceptvar/wg_dist alpha, minimum, impconceptvar/cohesiveness alpha


def _own(classes, prefix: str) -> Column:
    """Column ``{prefix}{c}`` of the row's own class."""
    expr = F.lit(None)
    for c, name in enumerate(classes):
        expr = F.when(F.col("y") == name, F.col(f"{prefix}{c}")).otherwise(expr)
    return expr


def _per_row(df: DataFrame, feature: str, value: Column) -> DataFrame:
    return df.select(entry(feature, value, attr=F.col("row_id").cast("string")).alias("e")).select("e.*")


def _group(y: str = "y") -> Column:
    """The label as a group that equals itself also where it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(y).cast("string")), F.lit(""))


def neighbour_stats(mat: DataFrame, metric: str, block_rows: int) -> DataFrame:
    """``pair_stats`` of ``NEIGHBOURS`` for (row_id, y, x) by searches over
    cells: nearest row of the own class, nearest row, nearest enemy."""
    size = min(CELL_ROWS, block_rows)
    mat = written(mat.select("row_id", "y", "x", _group().alias("g")), "neighbours-rows")
    own = nearest_own(mat, metric, size).withColumnRenamed("d", "_own")
    nn = nearest_rows(mat, 1, metric, size).select("row_id", F.col("d").alias("_nn"), F.col("id").alias("nn_id"), F.col("y").alias("nn_y"))
    ne = Enemies(mat, metric, size).nearest(mat.select("row_id", "g")).select("row_id", F.col("ne_d").alias("_ne"), "ne_id")
    inf = F.lit(float("inf"))
    return mat.select("row_id", "y").join(own, "row_id", "left").join(nn, "row_id", "left").join(ne, "row_id", "left").select(
        "row_id", "y", F.when(F.col("y").isNotNull(), F.coalesce("_own", inf)).alias("own_d"),
        F.coalesce("_nn", inf).alias("nn_d"), F.coalesce("nn_id", F.lit(-1)).alias("nn_id"), "nn_y",
        F.coalesce("_ne", inf).alias("ne_d"), F.coalesce("ne_id", F.lit(-1)).alias("ne_id"))


class PairContext:
    """Kernel results shared by the features of one Frame, metric and scale."""

    def __init__(self, fr: Frame, metric: str = "euclidean", scale: str | None = None,
                 block_rows: int = 2048, concept: tuple | None = None, want=STATS):
        self.fr = fr
        self.want = want
        self.metric = metric
        self.classes = sorted_classes(fr)
        self.mat = scaled_matrix(fr, scale).cache()
        self.n = self.mat.count()
        self.block_rows = block_rows
        self.concept = concept
        self._stats = None

    @property
    def by_cells(self) -> bool:
        """Whether all that is wanted are nearest rows, of many."""
        return self.n > PAIR_ROWS and tuple(self.want) == NEIGHBOURS and self.concept is None

    @property
    def stats(self) -> DataFrame:
        if self._stats is None and self.by_cells:
            self._stats = neighbour_stats(self.mat, self.metric, self.block_rows).cache()
        if self._stats is None:
            self._stats = pair_stats(self.mat, self.classes, self.metric, self.block_rows,
                                     concept=self.concept, n=self.n, want=self.want).cache()
        return self._stats

    def class_table(self):
        """k x k matrices from one groupBy over the per-row statistics."""
        k = len(self.classes)
        rows = self.stats.groupBy("y").agg(
            F.count(F.lit(1)).alias("cnt"),
            *[F.min(f"mn{c}").alias(f"mn{c}") for c in range(k)],
            *[F.max(f"mx{c}").alias(f"mx{c}") for c in range(k)],
            *[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)]).collect()  # one row per class
        by = {r["y"]: r for r in rows}
        cnt = np.array([by[c]["cnt"] for c in self.classes], dtype=float)
        mn = np.array([[by[a][f"mn{b}"] for b in range(k)] for a in self.classes], dtype=float)
        mx = np.array([[by[a][f"mx{b}"] for b in range(k)] for a in self.classes], dtype=float)
        s = np.array([[by[a][f"s{b}"] for b in range(k)] for a in self.classes], dtype=float)
        return cnt, mn, mx, s


# ------------------------------------------------------------------ clustering
def ft_vdu(ctx: PairContext) -> DataFrame:
    cnt, mn, mx, _ = ctx.class_table()
    k = len(cnt)
    inter = min((mn[a, b] / (cnt[a] * cnt[b]) for a in range(k) for b in range(a + 1, k)), default=math.inf)
    intra = max(mx[c, c] for c in range(k))
    return M.values_frame(ctx.fr.spark, "vdu", [float(inter / intra)])


def ft_int(ctx: PairContext) -> DataFrame:
    cnt, _, _, s = ctx.class_table()
    k = len(cnt)
    if k == 1:
        return M.values_frame(ctx.fr.spark, "int", [float("nan")])
    tot = sum(s[a, b] / (cnt[a] * cnt[b]) for a in range(k) for b in range(a + 1, k))
    return M.values_frame(ctx.fr.spark, "int", [float(tot * 2.0 / (k * (k - 1.0)))])


def silhouette_rows(ctx: PairContext) -> DataFrame:
    """(row_id, s) per-row silhouette (0 for rows of singleton classes)."""
    k = len(ctx.classes)
    cnt, *_ = ctx.class_table()
    own_n = _own(ctx.classes, "n")
    a = _own(ctx.classes, "s") / own_n
    b = None
    for c, name in enumerate(ctx.classes):
        mean_c = F.when(F.col("y") != name, F.col(f"s{c}") / F.lit(float(cnt[c])))
        b = mean_c if b is None else F.least(b, mean_c)  # least skips nulls
    s = F.when(own_n == 0, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return ctx.stats.select("row_id", "y", s.alias("s"))


def ft_sil(ctx: PairContext) -> DataFrame:
    r = silhouette_rows(ctx).agg(F.avg("s").alias("v"))
    return r.select(entry("sil", F.col("v")).alias("e")).select("e.*")


def ft_pb(ctx: PairContext) -> DataFrame:
    k = len(ctx.classes)
    sum_d = sum(F.col(f"s{c}") for c in range(k))
    r = ctx.stats.agg(F.sum(sum_d).alias("sd"), F.sum("sumsq").alias("sdd"),
                      F.sum(_own(ctx.classes, "n")).cast("double").alias("sf"),
                      F.sum(_own(ctx.classes, "s")).alias("sfd"))
    n2 = float(ctx.n) * (ctx.n - 1.0)
    num = F.lit(n2) * F.col("sfd") - F.col("sf") * F.col("sd")
    den = F.sqrt((F.lit(n2) * F.col("sf") - F.col("sf") * F.col("sf")) * (F.lit(n2) * F.col("sdd") - F.col("sd") * F.col("sd")))
    return r.select(entry("pb", num / den).alias("e")).select("e.*")


# ------------------------------------------------------------------ complexity
def nearest_enemy(ctx: PairContext) -> DataFrame:
    """XX1: (row_id, ne_d, ne_id), found by cells (``cells.Enemies``); a row
    without one has distance infinity and id -1."""
    found = Enemies(ctx.mat, ctx.metric, ctx.block_rows).nearest(ctx.mat.select("row_id", F.col("y").alias("g")))
    return ctx.mat.select("row_id").join(found, "row_id", "left").select(
        "row_id", F.coalesce("ne_d", F.lit(float("inf"))).alias("ne_d"), F.coalesce("ne_id", F.lit(-1)).alias("ne_id"))


def ft_n2(ctx: PairContext) -> DataFrame:
    v = 1.0 - 1.0 / (1.0 + F.col("own_d") / F.col("ne_d"))
    return _per_row(ctx.stats, "n2", v)


def ft_n3(ctx: PairContext) -> DataFrame:
    return _per_row(ctx.stats, "n3", (F.col("nn_y") != F.col("y")).cast("double"))


def ft_lsc(ctx: PairContext) -> DataFrame:
    thr = ctx.stats.select("row_id", F.col("ne_d").alias("thresh"))
    if ctx.by_cells:  # of equal rows one point, which weighs as many
        size = min(CELL_ROWS, ctx.block_rows)
        point = ctx.mat.groupBy("x").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).cast("string").alias("y"))
        none = F.lit(None).cast("string").alias("g")
        cells = Cells(point.select("row_id", "y", none, "x"), ctx.metric, size)
        asked = ctx.mat.join(thr, "row_id").select(F.col("row_id").alias("qid"), none, "x", F.col("thresh").alias("limit"))
        b = cells.count_within(asked, strict=True).agg(F.sum("n")).first()[0]  # the row itself where its limit is above zero
        return M.values_frame(ctx.fr.spark, "lsc", [1.0 - float(b) / float(ctx.n) ** 2])
    st = pair_stats(ctx.mat, ctx.classes, ctx.metric, ctx.block_rows, thresh=thr, n=ctx.n, want=())
    r = st.join(thr, "row_id").agg(
        (F.sum("below") + F.count_if(F.col("thresh") > 0)).cast("double").alias("b"))
    n2 = float(ctx.n) ** 2
    return r.select(entry("lsc", 1.0 - F.col("b") / F.lit(n2)).alias("e")).select("e.*")


# --------------------------------------------------------------------- concept
def ft_conceptvar(ctx: PairContext) -> DataFrame:
    return _per_row(ctx.stats, "conceptvar", F.col("w_other") / F.col("w_all"))


def ft_wg_dist(ctx: PairContext) -> DataFrame:
    return _per_row(ctx.stats, "wg_dist", F.col("w_d") / F.col("w_all"))


def ft_impconceptvar(ctx: PairContext) -> DataFrame:
    return _per_row(ctx.stats, "impconceptvar", F.col("imp_other"))


def ft_cohesiveness(ctx: PairContext) -> DataFrame:
    return _per_row(ctx.stats, "cohesiveness", F.col("imp_all"))


def concept_context(fr: Frame, alpha: float = 2.0, minimum: float = 1e-9, imp_alpha: float = 1.0,
                    block_rows: int = 2048) -> PairContext:
    return PairContext(fr, "euclidean", "minmax", block_rows,
                       concept=(alpha, minimum, float(len(fr.num)), imp_alpha), want=())


# ------------------------------------------------------------------ neighbours
def knn_table(fr: Frame, n_neighbors: int | None = None, metric: str = "euclidean",
              block_rows: int = 2048) -> DataFrame:
    """KX2: (row_id, rank, nb_id, nb_dist, nb_y); k = int(sqrt(min class size)).
    Found by cells of about ``block_rows`` rows, which only rows near enough
    visit."""
    if n_neighbors is None:
        m = fr.df.groupBy(fr.y()).count().agg(F.min("count")).first()[0]
        n_neighbors = max(1, int(math.sqrt(m)))
    found = nearest_rows(scaled_matrix(fr, None), n_neighbors, metric, block_rows)
    return found.select("row_id", "rank", F.col("id").alias("nb_id"), F.col("d").alias("nb_dist"), F.col("y").alias("nb_y"))


def knn_vote(fr: Frame, k: int = 5, block_rows: int = 2048) -> DataFrame:
    """(row_id, y, pred): majority label of the k nearest other rows
    (ties -> smallest label), Euclidean."""
    tbl = knn_table(fr, n_neighbors=k, block_rows=block_rows)
    votes = tbl.groupBy("row_id", "nb_y").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("row_id").agg(F.min(F.struct((-F.col("v")).alias("nv"), F.col("nb_y"))).alias("b"))
    return best.select("row_id", F.col("b.nb_y").alias("pred"))


def _train_neighbours(train: Frame, valid: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(row_id, nb_y): labels of the k nearest train rows of every validation
    row."""
    rid = F.col(train.row_id).cast("long").alias("row_id")
    x = F.array(*[F.col(c).cast("double") for c in train.num]).alias("x")
    found = nearest_in(train.df.select(rid, train.y().alias("y"), x), valid.select(rid, x), k, "euclidean", block_rows)
    return found.select("row_id", F.col("y").alias("nb_y"))


def knn_predict(train: Frame, valid: DataFrame, k: int = 5, block_rows: int = 2048) -> DataFrame:
    """k-NN vote for validation rows using only train rows (ties -> smallest
    label); both have the train frame's row key."""
    votes = _train_neighbours(train, valid, k, block_rows).groupBy("row_id", "nb_y").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("row_id").agg(F.min(F.struct((-F.col("v")).alias("nv"), F.col("nb_y"))).alias("b"))
    return valid.join(best.select(F.col("row_id").alias("_rid"), F.col("b.nb_y").alias("pred")),
                      F.col(train.row_id).cast("long") == F.col("_rid")).drop("_rid")


def knn_regress(train: Frame, valid: DataFrame, k: int = 5, block_rows: int = 2048) -> DataFrame:
    """E8, regression form: the mean target of the k nearest train rows; adds
    ``pred``.  Targets travel with the neighbours, so any number of distinct
    values will do."""
    mean = _train_neighbours(train, valid, k, block_rows).groupBy("row_id").agg(F.avg(F.col("nb_y").cast("double")).alias("pred"))
    return valid.join(mean.select(F.col("row_id").alias("_rid"), "pred"), F.col(train.row_id).cast("long") == F.col("_rid")).drop("_rid")


def ft_n4(fr: Frame, metric: str = "gower", seed: int = 0, block_rows: int = 2048) -> DataFrame:
    """1-NN error of interpolated rows (per class convex blends of
    min-max scaled rows) classified by the original rows; per interpolated
    row 1 = misclassified.  Interpolated rows visit the cells of original rows
    that can hold their nearest."""
    from .splits import interpolate_rows
    # even numbers are rows, odd ones blends, in the order of the row keys
    mat = (rank_within(scaled_matrix(fr, "minmax"), [], ["row_id"], "_rk")
           .select((F.col("_rk") * 2).alias("row_id"), "y", "x"))
    cols = [f"x{i}" for i in range(len(fr.num))]
    flat = mat.select("row_id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    sf = Frame(df=flat, num=tuple(cols), cat=(), label="y", row_id="row_id")
    inter = interpolate_rows(sf, seed=seed)
    new = written(inter.select((F.col("row_id") + 1).alias("row_id"), F.col("y").cast("string").alias("_y"), F.array(*cols).alias("x")), "n4-blends")
    found = nearest_in(mat, new.select("row_id", "x"), 1, metric)
    test = new.select("row_id", "_y").join(found.select("row_id", F.col("y").alias("nn_y")), "row_id")
    return _per_row(test, "n4", (F.col("nn_y") != F.col("_y")).cast("double"))


#: Nearest rows that a row knows before the rounds of a spanning forest.
FOREST_LINKS = 16


def minimum_spanning_forest(fr: Frame, metric: str = "gower", scale: str | None = "minmax",
                            block_rows: int = 2048, links: int = FOREST_LINKS, log: list | None = None) -> DataFrame:
    """Exact minimum spanning forest of the complete distance graph (zero
    distances are no edge) by Boruvka rounds.

    Equal rows are one point: every further copy hangs on the nearest row of
    its point.  Points know their ``links`` nearest points (one search over
    cells); each round drops those in their own component, and the component's
    lightest edge under the total order (d, low id, high id) is the least of
    what is left.  Only a point without links, none of whose unknown
    neighbours need be farther than that edge, searches again, no farther than
    the edge (a component without any edge asks one point first).  Components
    merge by pointer jumping on the component table.  O(log n) rounds, each
    written to the shared folder.  ``log`` takes the number of points of each
    search.  Returns edges (src, dst, d).
    """
    mat = written(scaled_matrix(fr, scale).select("row_id", "x"), "forest-rows")
    point = written(mat.groupBy("x").agg(F.min("row_id").alias("row_id")).select("row_id", "x"), "forest-points")
    none = F.lit(None).cast("string")
    cells = Cells(point.select("row_id", none.alias("y"), none.alias("g"), "x"), metric, min(CELL_ROWS, block_rows))
    dealt = cells.points
    inf = F.lit(float("inf"))

    def search(asks: DataFrame, by_group: bool) -> tuple[DataFrame, DataFrame]:
        """(row_id, nb, d) found for (qid, g, x, limit), and (row_id, beyond):
        every point not found lies at least so far."""
        if log is not None:
            log.append(asks.count())
        found = written(cells.nearest(asks, links, by_group=by_group, positive=True)
                        .select(F.col("qid").alias("row_id"), F.col("id").alias("nb"), "d", "rank"), "forest-found")
        full = found.where(F.col("rank") == links).select("row_id", F.col("d").alias("kth"))
        # not found within the limit: farther than it, by one unit in the last place at least
        past = F.when(F.col("limit") == inf, inf).otherwise(F.col("limit") * (1 + 2.0 ** -52) + 5e-324)
        limit = F.col("limit") if "limit" in asks.columns else inf
        reach = asks.select(F.col("qid").alias("row_id"), limit.alias("limit")).join(full, "row_id", "left")
        return found, reach.select("row_id", F.coalesce("kth", past).alias("beyond"))

    known, reach = search(point.select(F.col("row_id").alias("qid"), none.alias("g"), "x"), False)
    reach = written(reach, "forest-reach")
    # copies of a point: an edge each to the nearest row of another point
    first = known.where(F.col("rank") == 1).select(F.col("row_id").alias("rep"), "nb", "d")
    copies = mat.join(point.withColumnRenamed("row_id", "rep"), "x").where(F.col("row_id") != F.col("rep")).join(first, "rep")
    edges = [copies.select(F.least("row_id", "nb").alias("lo"), F.greatest("row_id", "nb").alias("hi"), "d")]
    known = known.drop("rank")
    comp = written(point.select("row_id", F.col("row_id").alias("comp")), "forest-comp")
    while True:  # a merge at least halves the components that have an edge
        mine, other = comp.withColumnRenamed("comp", "a"), comp.select(F.col("row_id").alias("nb"), F.col("comp").alias("b"))
        known = written(known.select("row_id", "nb", "d").join(mine, "row_id").join(other, "nb").where(F.col("a") != F.col("b")), "forest-links")
        least = written(known.groupBy("a").agg(F.min(F.struct(
            "d", F.least("row_id", "nb").alias("lo"), F.greatest("row_id", "nb").alias("hi"), "b")).alias("e")).select("a", "e.*"), "forest-least")
        asks = (reach.where(F.col("beyond") < inf).join(known.select("row_id").distinct(), "row_id", "left_anti").join(mine, "row_id")
                .join(least.select("a", F.col("d").alias("limit")), "a", "left")
                .where(F.col("limit").isNull() | (F.col("beyond") <= F.col("limit"))))
        alone = asks.where(F.col("limit").isNull()).groupBy("a").agg(F.min("row_id").alias("row_id")).select("row_id")
        asks = asks.where(F.col("limit").isNotNull()).select("row_id", "a", "limit").unionByName(
            asks.join(alone, "row_id", "left_semi").select("row_id", "a", inf.alias("limit")))
        asks = written(asks.join(point, "row_id").select(F.col("row_id").alias("qid"), F.col("a").cast("string").alias("g"), "x", "limit"), "forest-asks")
        if not asks.isEmpty():
            cells.points = written(dealt.drop("g").join(comp.select("row_id", F.col("comp").cast("string").alias("g")), "row_id")
                                   .select("row_id", "y", "g", "x", "cell"), "forest-groups")
            found, now = search(asks, True)
            known = known.select("row_id", "nb", "d").unionByName(found.select("row_id", "nb", "d"))
            # a component whose point found nothing without a limit is the only one within reach
            over = (asks.where(F.col("limit") == inf).join(found.select(F.col("row_id").alias("qid")), "qid", "left_anti")
                    .select(F.col("g").cast("long").alias("a"), F.lit(True).alias("over")))
            reach = written(reach.join(now.withColumnRenamed("beyond", "now"), "row_id", "left").join(mine, "row_id").join(over, "a", "left").select(
                "row_id", F.when(F.col("over"), inf).otherwise(F.coalesce("now", "beyond")).alias("beyond")), "forest-reach")
            continue
        if least.isEmpty():
            break
        edges.append(least.select("lo", "hi", "d"))
        # pointer of each component = component of its edge's other end; of two that point at each other the smaller stays
        back = least.select(F.col("a").alias("b"), F.col("b").alias("bb"))
        ptr = written(least.select("a", "b").join(back, "b").select(
            F.col("a").alias("comp"), F.when((F.col("bb") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("p")), "forest-pointers")
        while True:  # pointer jumping, three steps a round: O(log #components) rounds
            hop = ptr.select(F.col("comp").alias("p"), F.col("p").alias("p2"))
            two = ptr.join(hop, "p", "left").select("comp", F.col("p").alias("old"), F.coalesce("p2", "p").alias("p"))
            nxt = written(two.join(hop, "p", "left").select(
                "comp", F.coalesce("p2", "p").alias("p"), (F.coalesce("p2", "p") != F.col("old")).alias("moved")), "forest-pointers")
            moved = not nxt.where("moved").isEmpty()
            ptr = nxt.drop("moved")
            if not moved:
                break
        comp = written(comp.join(ptr, "comp", "left").select("row_id", F.coalesce("p", "comp").alias("comp")), "forest-comp")
    out = union_all(edges).distinct()
    return out.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "d")


def ft_n1(fr: Frame, metric: str = "gower", block_rows: int = 2048) -> DataFrame:
    """Share of rows incident to a spanning-forest edge joining classes."""
    fr = keyed(fr, integral=True)
    edges = minimum_spanning_forest(fr, metric, "minmax", block_rows)
    lab = fr.df.select(F.col(fr.row_id).cast("long").alias("id"), fr.y().alias("y"))
    e = (edges.join(lab.withColumnRenamed("id", "src").withColumnRenamed("y", "ys"), "src")
         .join(lab.withColumnRenamed("id", "dst").withColumnRenamed("y", "yd"), "dst")
         .where(F.col("ys") != F.col("yd")))
    verts = e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct()
    n = float(fr.count())
    return verts.agg(F.count(F.lit(1)).alias("c")).select(entry("n1", F.col("c") / F.lit(n)).alias("e")).select("e.*")


def hypersphere_radii(ne: DataFrame) -> DataFrame:
    """Radius of each row's hypersphere from the nearest-enemy chain:
    mutual nearest enemies share half their distance; any other row's radius
    is |d(row, enemy) - radius(enemy)|.  Resolved by join rounds along the
    chain (one round per chain link); a row on an enemy cycle longer than two
    (only possible with distance ties) starts from radius 0.
    ``ne``: (row_id, ne_id, ne_d) -> (row_id, r)."""
    e2 = ne.select(F.col("row_id").alias("ne_id"), F.col("ne_id").alias("_ne2"))
    cur = ne.join(e2, "ne_id", "left").select(
        "row_id", "ne_id", "ne_d", F.when(F.col("_ne2") == F.col("row_id"), 0.5 * F.col("ne_d")).alias("r"))
    cur = cur.checkpoint(eager=True)
    while True:  # every round settles a link of each chain, or the cycles
        unknown = cur.where(F.col("r").isNull()).count()
        if unknown == 0:
            break
        known = cur.where(F.col("r").isNotNull()).select(F.col("row_id").alias("ne_id"), F.col("r").alias("_re"))
        nxt = cur.join(known, "ne_id", "left").select(
            "row_id", "ne_id", "ne_d",
            F.coalesce("r", F.abs(F.col("ne_d") - F.col("_re"))).alias("r")).checkpoint(eager=True)
        if nxt.where(F.col("r").isNull()).count() == unknown:  # only cycles left
            nxt = nxt.withColumn("r", F.coalesce("r", F.col("ne_d"))).checkpoint(eager=True)
        cur = nxt
    return cur.select("row_id", "r")


def ft_t1(fr: Frame, metric: str = "gower", block_rows: int = 2048) -> DataFrame:
    """Share of hyperspheres left after absorption (mass priority,
    centre reference).

    A sphere is *active* when no active sphere of higher priority contains its
    centre; it *survives* when, in addition, no other active sphere contains
    it.  Activity is settled in rounds (each one pass over the tiles of the
    spheres that are not absorbed yet): an undecided
    sphere becomes inactive once an active higher-priority container exists,
    and active once all its higher-priority containers are inactive.  The
    undecided sphere of highest priority is always settled, so the rounds
    end; the result equals the sequential absorption loop.
    """
    classes = sorted_classes(fr)
    mat = scaled_matrix(fr, "minmax").cache()
    n = mat.count()
    ne = Enemies(mat, metric, block_rows).nearest(mat.select("row_id", F.col("y").alias("g"))).select("row_id", "ne_id", "ne_d")
    radii = hypersphere_radii(ne)
    spheres = Spheres(mat, radii, metric, min(CELL_ROWS, block_rows)) if n > PAIR_ROWS else None
    if spheres is None:
        thr = radii.select("row_id", F.col("r").alias("thresh"))
        mass = pair_stats(mat, classes, metric, block_rows, thresh=thr, n=n, thresh_le=True, want=()) \
            .select("row_id", (F.col("below") + 1).alias("mass"))
    else:
        mass = spheres.mass()

    def containers(live, asked):
        return _containers(live, metric, block_rows, asked) if spheres is None else spheres.containers(live, asked)
    ordered = rank_within(mass.join(radii, "row_id").withColumn("_neg", -F.col("mass")), [], ["_neg", "row_id"], "ord")
    # only undecided spheres are asked, and absorbed ones contain nothing
    live = written(mat.select("row_id", "x").join(ordered.select("row_id", "r", "ord", F.lit(0).alias("st")), "row_id"), "t1-spheres")
    left = n
    while left:
        c = containers(live, 0)
        live = written(live.join(c, "row_id", "left").withColumn("st", F.when(F.col("st") != 0, F.col("st"))
                       .when(F.col("act") > 0, F.lit(2)).when(F.col("und") == 0, F.lit(1)).otherwise(F.lit(0)))
                       .where("st != 2").drop("act", "und", "any"), "t1-spheres")
        left = live.where("st = 0").count()
    surv = containers(live, 1).where("any = 0")
    return surv.agg(F.count(F.lit(1)).alias("c")).select(entry("t1", F.col("c") / F.lit(float(n))).alias("e")).select("e.*")


class Spheres:
    """Spheres (row_id, r) around rows (row_id, y, x): each visits the cells that
    it can reach, which are chosen once, since rows and radii stay."""

    def __init__(self, mat: DataFrame, radii: DataFrame, metric: str, cell_rows: int):
        none = F.lit(None).cast("string")
        self.metric = metric
        self.cells = Cells(mat.select("row_id", F.lit("1").alias("y"), none.alias("g"), "x"), metric, cell_rows)
        self.dealt = self.cells.points.select("row_id", "x", "cell")
        self.asks = written(mat.select("row_id", "x").join(radii, "row_id").select(
            F.col("row_id").alias("qid"), none.alias("g"), "x", F.col("r").alias("limit")), "spheres-asks")
        self.reach = None

    def mass(self) -> DataFrame:
        """(row_id, mass): rows inside each sphere, its own among them."""
        return self.cells.count_within(self.asks, strict=False).select(F.col("qid").alias("row_id"), F.col("n").alias("mass"))

    def containers(self, live: DataFrame, asked: int) -> DataFrame:
        """``_containers`` by visits of spheres to the cells of the centres asked about."""
        metric = self.metric
        if self.reach is None:  # also cells inside a sphere: their centres are told one by one
            self.reach = written(self.cells._to_visit(self.asks, 0, None, False), "spheres-reach")
        state = live.select("row_id", (F.col("ord") * 4 + F.col("st")).cast("string").alias("code"))
        none = F.lit(None).cast("string")
        self.cells.points = written(self.dealt.join(state.join(live.where(F.col("st") == asked).select("row_id"), "row_id", "left_semi"), "row_id")
                                    .select("row_id", F.col("code").alias("y"), none.alias("g"), "x", "cell"), "spheres-centres")
        visits = self.reach.drop("g").join(state.select(F.col("row_id").alias("qid"), F.col("code").alias("g")), "qid").select("qid", "g", "x", "limit", "cell")

        def tile(visitors, residents):
            if not len(visitors) or not len(residents):
                return pd.DataFrame({"row_id": [], "act": [], "und": [], "any": []})
            X = np.array(residents["x"].tolist(), dtype=float).reshape(len(residents), -1)
            ids, rank = residents["row_id"].to_numpy(), residents["y"].astype("int64").to_numpy() // 4
            sums = np.zeros((3, len(ids)), dtype="int64")
            for a in range(0, len(visitors), 512):
                part = visitors.iloc[a:a + 512]
                code = part["g"].astype("int64").to_numpy()
                inside = _dist(X, np.array(part["x"].tolist(), dtype=float).reshape(len(part), -1), metric) <= part["limit"].to_numpy()[None, :]
                inside &= ids[:, None] != part["qid"].to_numpy()[None, :]
                before = inside & (code[None, :] // 4 < rank[:, None])
                act, und = code % 4 == 1, code % 4 == 0
                sums += [np.count_nonzero(before[:, act], axis=1), np.count_nonzero(before[:, und], axis=1), np.count_nonzero(inside[:, act], axis=1)]
            return pd.DataFrame({"row_id": ids, "act": sums[0], "und": sums[1], "any": sums[2]})
        found = self.cells._meet(visits, tile, "row_id long, act long, und long, any long")
        # a centre that no sphere reaches has no container
        rest = live.where(F.col("st") == asked).select("row_id", *[F.lit(0).cast("long").alias(c) for c in ("act", "und", "any")])
        return found.unionByName(rest).groupBy("row_id").agg(*[F.sum(c).alias(c) for c in ("act", "und", "any")])


def _containers(live: DataFrame, metric: str, block_rows: int, asked: int) -> DataFrame:
    """(row_id, act, und, any): for every sphere of ``live`` (row_id, x, r, ord,
    st) in state ``asked``, how many active and undecided ones of higher
    priority contain its centre, and how many active ones of any."""
    blocks = max(1, math.ceil(live.count() / block_rows))

    def tile(key, pdf):
        X = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
        ids, r, rank, st, blk = (pdf[c].to_numpy() for c in ("row_id", "r", "ord", "st", "_blk"))
        out = []
        for own, other in ((key[0], key[1]), (key[1], key[0]))[:1 + (key[0] != key[1])]:
            i, j = np.flatnonzero((blk == own) & (st == asked)), np.flatnonzero(blk == other)
            inside = _dist(X[i], X[j], metric) <= r[j][None, :]
            inside &= ids[i][:, None] != ids[j][None, :]
            before = inside & (rank[j][None, :] < rank[i][:, None])
            act, und = st[j] == 1, st[j] == 0
            out.append(pd.DataFrame({"row_id": ids[i], "act": np.count_nonzero(before[:, act], axis=1),
                                     "und": np.count_nonzero(before[:, und], axis=1), "any": np.count_nonzero(inside[:, act], axis=1)}))
        return pd.concat(out, ignore_index=True)
    tiles = spread(tiled(live, blocks), blocks * (blocks + 1) // 2, "_ta", "_tb").groupBy("_ta", "_tb")
    return tiles.applyInPandas(tile, "row_id long, act long, und long, any long").groupBy("row_id").agg(*[F.sum(c).alias(c) for c in ("act", "und", "any")])


def _reach(metric: str, columns: int) -> float:
    """The greatest distance of min-max scaled rows."""
    return {"euclidean": math.sqrt(columns), "gower": 1.0}.get(metric, float(columns)) * (1 + 1e-9)


def _kth(fr: Frame, metric: str, radius_frac: float, block_rows: int):
    """(scaled rows, their number, each row's k-th neighbour), k = round(0.15 n);
    written once a Frame: density, cls_coef and hubs have the same graph."""
    return fr.memo(("kth", metric, radius_frac, block_rows), lambda: _find_kth(fr, metric, radius_frac, block_rows))


def _find_kth(fr: Frame, metric: str, radius_frac: float, block_rows: int):
    mat = scaled_matrix(fr, "minmax").cache()
    n = mat.count()
    k = int(round(n * radius_frac)) if 0 < radius_frac < 1 else int(radius_frac)
    k = max(1, min(k, n - 1))
    return mat, n, written(kth_neighbours(mat, k, metric, n, _reach(metric, len(fr.num)), block_rows), "kth")


def ft_density(fr: Frame, metric: str = "gower", radius_frac: float = 0.15, block_rows: int = 2048) -> DataFrame:
    """1 - density of the graph linking each row to its round(0.15 n)
    nearest rows of the same class (positive distances, either direction).

    No edge list: counting passes find each row's k-th neighbour (distance,
    id); another, over pairs of blocks of a class, counts each row's edges
    under the exact (distance, id) neighbour order."""
    mat, n, kth = _kth(fr, metric, radius_frac, block_rows)
    e = ClassBlocks(mat, kth, metric, block_rows).degrees().agg((F.sum("deg") / 2.0).alias("E"))
    dens = F.col("E") * 2.0 / (float(n) * (n - 1.0))
    return e.select(entry("density", 1.0 - dens).alias("e")).select("e.*")


def knn_graph_edges(fr: Frame, metric: str = "gower", radius_frac: float = 0.15, block_rows: int = 2048) -> DataFrame:
    """Undirected edges (a < b) of the same-class round(0.15 n)-NN graph with
    positive distances.  The graph is the feature's own object, so its edges
    are written here, a row each; density avoids them."""
    mat, n, kth = _kth(fr, metric, radius_frac, block_rows)
    return neighbour_edges(mat, written(kth, "kth"), metric, n, block_rows)


def ft_cls_coef(fr: Frame, metric: str = "gower", radius_frac: float = 0.15, block_rows: int = 2048) -> DataFrame:
    """1 - global transitivity (3 x triangles / connected triples) of the
    k-NN graph.  Wedges are joined and closed by blocks of a class, three at a
    time; neither edges nor wedges are listed."""
    mat, n, kth = _kth(fr, metric, radius_frac, block_rows)
    graph = ClassBlocks(mat, kth, metric, block_rows)
    triples = graph.degrees().agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2.0).alias("t")).first()["t"] or 0.0
    tri = graph.triangles().agg(F.sum("n")).first()[0] or 0
    v = 1.0 - (3.0 * tri / triples if triples > 0 else 0.0)
    return fr.spark.range(1).select(entry("cls_coef", F.lit(float(v))).alias("e")).select("e.*")


def ft_hubs(fr: Frame, metric: str = "gower", radius_frac: float = 0.15, block_rows: int = 2048,
            tol: float = 1e-9, max_steps: int = 300) -> DataFrame:
    """1 - hub score per row of the k-NN graph (principal eigenvector of
    A A^T = A^2 for the undirected graph, scaled to max 1).

    Lanczos from the vector of ones: it reaches the limit of power iteration
    in far fewer products when leading eigenvalues are close.  The graph is
    kept as bits of blocks of a class (``ClassBlocks.kept``), vectors as packed
    blocks; a step is two products of tiles and blocks and aggregates of inner
    products; the basis is written every step.  Only the small projected
    matrix is on the driver.  Raises where ``max_steps`` do not reach ``tol``."""
    mat, n, kth = _kth(keyed(fr, integral=True), metric, radius_frac, block_rows)
    if n == 0:
        return empty_long(fr.spark)
    graph = ClassBlocks(mat, kth, metric, block_rows)
    links = graph.kept()

    def first(batches):
        for b in batches:
            b["q"] = [np.full(m, 1.0 / math.sqrt(n)).tobytes() for m in b["n"]]
            b["x"] = b["q"]
            yield b[["c", "blk", "ids", "q", "x"]]

    def dots(batches):
        """Inner products of x, less what is ``lost`` of the basis, with the
        basis, and of x with itself (-1)."""
        for b in batches:
            for r in b.itertuples():
                x = np.frombuffer(r.x, float)
                q = np.frombuffer(r.q, float).reshape(-1, len(x))
                x = x - lost @ q
                yield pd.DataFrame({"j": np.arange(-1, len(q)), "v": np.concatenate([[x @ x], q @ x])})

    def extend(batches):
        for b in batches:
            for r in b.itertuples():
                x = np.frombuffer(r.x, float)
                x = (x - lost @ np.frombuffer(r.q, float).reshape(-1, len(x))) / beta
                yield pd.DataFrame({"c": [r.c], "blk": [r.blk], "ids": [r.ids], "q": [r.q + x.tobytes()], "x": [x.tobytes()]})

    def combine(batches):
        for b in batches:
            for r in b.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"v": ids, "x": np.abs(top @ np.frombuffer(r.q, float).reshape(-1, len(ids)))})

    schema = "c string, blk int, ids binary, q binary, x binary"
    basis = written(graph.blocks.select("c", "blk", "n", "ids").mapInPandas(first, schema), "hubs-basis")
    alphas, betas = [], []
    while True:
        w = written(basis.drop("x").join(product(links, product(links, basis.select("c", "blk", "x"))), ["c", "blk"]), "hubs-product")
        k = len(alphas) + 1
        lost = np.zeros(k)
        for again in (True, True, False):  # a second pass keeps the basis orthogonal to rounding
            got = {r["j"]: r["v"] for r in w.mapInPandas(dots, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}  # a row a step
            if again:
                lost = lost + np.array([got[j] for j in range(k)])
        beta = math.sqrt(got[-1])
        alphas.append(float(lost[-1]))
        small = np.diag(alphas) + np.diag(betas, 1) + np.diag(betas, -1)
        values, vectors = np.linalg.eigh(small)
        top = vectors[:, -1]
        scale = max(abs(values[-1]), 1e-300)
        if beta <= 1e-12 * scale or beta * abs(top[-1]) < tol * scale or k >= n:
            break
        if k >= max_steps:
            raise NotComputable(f"hub scores did not converge in {max_steps} steps")
        betas.append(beta)
        basis = written(w.mapInPandas(extend, schema), "hubs-basis")
    scores = written(basis.mapInPandas(combine, "v long, x double"), "hubs-scores")
    most = scores.agg(F.max("x")).first()[0] or 1.0
    return scores.select(entry("hubs", 1.0 - F.col("x") / F.lit(most), attr=F.col("v").cast("string")).alias("e")).select("e.*")
