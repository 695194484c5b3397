"""Metric partitioner: exact nearest rows without all pairs.

Rows are dealt to the cells of pivots (each to its nearest pivot).  Of every
cell a few numbers are kept: how near and how far its rows lie from its own
pivot and from a handful of reference pivots.  By the triangle inequality they
give a lower bound of the distance from any row to anything in the cell, so a
row is sent only to cells that can still hold a nearer one: first its own,
then the few most promising ones, then whatever its k-th distance so far
cannot rule out.

Equal rows are one point: a value that a third of the rows share is searched
for once.  A tile is a block of a cell against a slice of its visitors, both
of bounded size; what a task returns is at most k rows a visitor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..session import written
from .pairs import _dist

#: Rows that a cell should hold, and the most pivots that are made.
CELL_ROWS, MAX_PIVOTS = 512, 2048
#: Pivots whose distances bound every cell besides its own.
REFERENCES = 16
#: Rows of a block of a cell, and of a slice of its visitors.
BLOCK_ROWS, VISIT_ROWS = 2048, 8192
#: Cells that a row has visited after each round; the last round has no limit.
ROUNDS = (1, 5, None)
_CHUNK = 512


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


@dataclass
class Geometry:
    """What the driver keeps of the cells: at most ``MAX_PIVOTS`` rows."""
    pivots: np.ndarray
    metric: str
    count: np.ndarray          # rows of a cell
    near: np.ndarray           # (references + 1, cells): least and greatest distance
    far: np.ndarray            # from the references, and (last) from the cell's own pivot
    between: np.ndarray        # pivot to pivot
    only: list                 # the group that all rows of a cell belong to, else None

    def bounds(self, X: np.ndarray, groups=None) -> tuple[np.ndarray, np.ndarray]:
        """(lower bounds to every cell, home cell) of some rows; the home cell
        comes first (-1), cells that hold nothing to find last (inf)."""
        D = _dist(X, self.pivots, self.metric)
        home = D.argmin(1)
        rows = np.arange(len(X))
        low = np.maximum(D - self.far[-1], self.near[-1] - D)
        own = D[rows, home][:, None]
        if self.metric == "euclidean":  # a row of another cell lies beyond the middle plane
            gap = np.maximum(self.between[home], 1e-300)
            low = np.maximum(low, (D * D - own * own) / (2 * gap))
        else:
            low = np.maximum(low, (D - own) / 2)
        for r in range(len(self.near) - 1):
            low = np.maximum(low, np.maximum(D[:, [r]] - self.far[r], self.near[r] - D[:, [r]]))
        low = np.maximum(low * (1 - 1e-9) - 1e-12, 0.0)  # never above the true distance by rounding
        low[rows, home] = -1.0
        low[:, self.count == 0] = np.inf
        if groups is not None:
            for c, g in enumerate(self.only):
                if g is not None:
                    low[groups == g, c] = np.inf
        return low, home


class Cells:
    """Points (row_id, y, g, x) dealt to cells, whose pivots are drawn from
    ``rows`` (by default the points).  ``visits`` counts the rows sent to
    blocks of cells, by round."""

    def __init__(self, points: DataFrame, metric: str = "euclidean", cell_rows: int = CELL_ROWS, rows: DataFrame | None = None,
                 block_rows: int = BLOCK_ROWS, visit_rows: int = VISIT_ROWS):
        self.spark, self.metric, self.visits = points.sparkSession, metric, []
        self.block_rows, self.visit_rows = block_rows, visit_rows
        points = points.select("row_id", "y", "g", "x")
        if rows is None:
            rows = points = written(points, "cells-rows")
        many = min(MAX_PIVOTS, math.ceil(rows.count() / cell_rows))
        drawn = rows.orderBy(F.xxhash64("row_id", F.lit(7)), "row_id").limit(many).select("x").collect()  # at most MAX_PIVOTS
        # no rows: one pivot of no dimensions, whose cell stays empty
        pivots = np.unique(np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), -1), axis=0) if drawn else np.zeros((1, 0))
        refs = min(REFERENCES, len(pivots))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    b["cell"] = _dist(_matrix(b["x"]), pivots, metric).argmin(1).astype("int32")
                    yield b

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                cell = b["cell"].to_numpy()
                D = _dist(_matrix(b["x"]), pivots, metric)
                D = np.column_stack([D[:, :refs], D[np.arange(len(b)), cell]])
                for c in np.unique(cell):
                    mine = D[cell == c]
                    yield pd.DataFrame({"cell": c, "ref": np.arange(refs + 1, dtype="int32"), "near": mine.min(0), "far": mine.max(0), "n": len(mine)})

        schema = "row_id long, y string, g string, x array<double>"
        self.points = written(points.mapInPandas(deal, f"{schema}, cell int"), "cells-points")
        k = len(pivots)
        near, far, count = np.full((refs + 1, k), np.inf), np.full((refs + 1, k), -np.inf), np.zeros(k, np.int64)
        rows = self.points.select("cell", "x").mapInPandas(measure, "cell int, ref int, near double, far double, n long").groupBy("cell", "ref").agg(
            F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")).collect()  # cells x references
        for r in rows:
            near[r["ref"], r["cell"]], far[r["ref"], r["cell"]], count[r["cell"]] = r["near"], r["far"], r["n"]
        self.geometry = Geometry(pivots, metric, count, near, far, _dist(pivots, pivots, metric), [None] * k)

    def _see_groups(self) -> None:
        only: list = [None] * len(self.geometry.count)
        for r in self.points.groupBy("cell").agg(F.min("g").alias("a"), F.max("g").alias("b")).collect():  # a row a cell
            if r["a"] == r["b"]:
                only[r["cell"]] = r["a"]
        self.geometry.only = only

    def _meet(self, visits: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(visitors, residents)`` for every block of a cell and slice of
        its visitors (qid, g, x, limit, cell)."""
        visits = written(visits, "cells-visits")
        there = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
        blocks = -(-self.geometry.count // self.block_rows)
        self.visits.append(int(sum(n * blocks[c] for c, n in there.items())))
        plan = [(int(c), int(max(1, blocks[c])), int(max(1, -(-n // self.visit_rows)))) for c, n in there.items()]
        plan = F.broadcast(self.spark.createDataFrame(plan, "cell int, blocks int, slices int"))  # at most MAX_PIVOTS rows
        left = visits.join(plan, "cell").withColumn("slice", F.pmod(F.xxhash64("qid"), "slices").cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "slice", "qid", "g", "x", "limit")
        right = self.points.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int")).withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("cell", "block", "slice", "row_id", "y", "g", "x")
        keys = ["cell", "block", "slice"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)

    def _to_visit(self, state: DataFrame, first: int, last: int | None, by_group: bool) -> DataFrame:
        """Visits of rows (qid, g, x, limit): their cells from place ``first``
        to ``last`` in order of the lower bounds, up to their limit."""
        geometry = self.geometry

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b) if geometry.count.any() else 0, _CHUNK):
                    part = b.iloc[a:a + _CHUNK]
                    low, _ = geometry.bounds(_matrix(part["x"]), part["g"].to_numpy(dtype=object) if by_group else None)
                    order = np.argsort(low, axis=1, kind="stable")[:, first:last]
                    bound = np.take_along_axis(low, order, 1)
                    row, place = np.nonzero((bound <= part["limit"].to_numpy()[:, None]) & np.isfinite(bound))
                    out = part.iloc[row].copy()
                    out["cell"] = order[row, place].astype("int32")
                    yield out
        return state.mapInPandas(choose, "qid long, g string, x array<double>, limit double, cell int")

    def nearest(self, queries: DataFrame, k: int, by_group: bool = False, positive: bool = False, own: bool = False) -> DataFrame:
        """(qid, rank, id, d, y): the k nearest points of each row of
        ``queries`` (qid, g, x), by distance and then id, the smallest first;
        with a column ``limit``, only points no farther than that.
        ``by_group``: only points of another group; ``own``: only points of the
        row's group; ``positive``: only points at a distance above zero."""
        metric = self.metric
        if by_group:
            self._see_groups()

        def tile(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
            if not len(visitors) or not len(residents):
                return pd.DataFrame({"qid": [], "d": [], "id": [], "y": []})
            residents = residents.sort_values("row_id")
            R, ids, ys = _matrix(residents["x"]), residents["row_id"].to_numpy(), residents["y"].to_numpy(dtype=object)
            rg, out = residents["g"].to_numpy(dtype=object), []
            for a in range(0, len(visitors), _CHUNK):
                part = visitors.iloc[a:a + _CHUNK]
                D = _dist(_matrix(part["x"]), R, metric)
                ok = D <= part["limit"].to_numpy()[:, None]
                if by_group:
                    ok &= part["g"].to_numpy(dtype=object)[:, None] != rg[None, :]
                if own:
                    ok &= part["g"].to_numpy(dtype=object)[:, None] == rg[None, :]
                if positive:
                    ok &= D > 0
                D = np.where(ok, D, np.inf)
                if D.shape[1] > k:  # only what is as near as the k-th
                    ok &= D <= np.partition(D, k - 1, axis=1)[:, [k - 1]]
                row, col = np.nonzero(ok)
                d = D[row, col]
                order = np.lexsort((col, d, row))
                row, col, d = row[order], col[order], d[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                top = place < k
                out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[row[top]], "d": d[top], "id": ids[col[top]], "y": ys[col[top]]}))
            return pd.concat(out, ignore_index=True)

        limited = "limit" in queries.columns  # such rows need no first rounds to learn how far to look
        limit = F.col("limit") if limited else F.lit(float("inf"))
        queries = written(queries.select("qid", F.col("g").cast("string").alias("g"), "x", limit.alias("limit")), "cells-queries")
        best, first = None, 0
        for last in (None,) if limited else ROUNDS:
            if best is None:
                state = queries
            else:  # rows that have k neighbours look no farther than the k-th
                full = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("kth"))
                state = queries.join(full, "qid", "left").withColumn("limit", F.least("limit", "kth")).drop("kth")
            found = self._meet(self._to_visit(state, first, last, by_group), tile, "qid long, d double, id long, y string")
            found = found if best is None else best.unionByName(found)
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).where(F.col("rank") <= k)
            best = written(ranked.select("qid", "d", "id", "y"), "cells-best")
            first = last
            if last is not None and last >= len(self.geometry.count):
                break
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).select("qid", "rank", "id", "d", "y")


    def near_visits(self, queries: DataFrame) -> DataFrame:
        """Visits of rows (qid, g, x, limit) to every cell that their limit can
        reach, also as rows (cell -1) with the number ``n`` of points in cells that
        lie within the limit as a whole, which nobody visits.  Points weigh ``y``."""
        geometry = self.geometry
        weight = np.zeros(len(geometry.count))
        for r in self.points.groupBy("cell").agg(F.sum(F.col("y").cast("long")).alias("w")).collect():  # a row a cell
            weight[r["cell"]] = r["w"]

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b) if geometry.count.any() else 0, _CHUNK):
                    part = b.iloc[a:a + _CHUNK]
                    X, limit = _matrix(part["x"]), part["limit"].to_numpy()[:, None]
                    low, _ = geometry.bounds(X)
                    # never below the true distance by rounding
                    most = (_dist(X, geometry.pivots, geometry.metric) + geometry.far[-1]) * (1 + 1e-9) + 1e-12
                    some = geometry.count > 0
                    whole = (most < limit) & some
                    row, cell = np.nonzero((low <= limit) & ~whole & some)
                    out = part.iloc[row].copy()
                    out["cell"], out["n"] = cell.astype("int32"), 0
                    sums = part.copy()
                    sums["cell"], sums["n"] = np.int32(-1), (whole @ weight).astype("int64")
                    yield pd.concat([out, sums])
        schema = "qid long, g string, x array<double>, limit double, cell int, n long"
        return written(queries.select("qid", F.col("g").cast("string").alias("g"), "x", "limit").mapInPandas(choose, schema), "cells-reach")

    def count_within(self, queries: DataFrame, strict: bool) -> DataFrame:
        """(qid, n): the weight ``y`` of the points nearer than (else: no farther
        than) the limit of each row of ``queries`` (qid, g, x, limit)."""
        metric = self.metric

        def tile(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
            if not len(visitors) or not len(residents):
                return pd.DataFrame({"qid": [], "n": []})
            R, w, out = _matrix(residents["x"]), residents["y"].astype("int64").to_numpy(), []
            for a in range(0, len(visitors), _CHUNK):
                part = visitors.iloc[a:a + _CHUNK]
                D, limit = _dist(_matrix(part["x"]), R, metric), part["limit"].to_numpy()[:, None]
                out.append(pd.DataFrame({"qid": part["qid"], "n": (D < limit if strict else D <= limit) @ w}))
            return pd.concat(out, ignore_index=True)
        visits = self.near_visits(queries)
        found = self._meet(visits.where("cell >= 0").drop("n"), tile, "qid long, n long")
        return found.unionByName(visits.where("cell < 0").select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("n"))


def _fewest(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The ``keep`` rows of smallest id of each ``by``: the limit is applied in
    every task before the shuffle, so a frequent value never meets as a whole."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("row_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def nearest_rows(mat: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS, log: list | None = None) -> DataFrame:
    """(row_id, rank, id, d, y): the k nearest OTHER rows of every row of
    ``mat`` (row_id, y, x), by distance and then id.  Equal rows are one point,
    of which k + 1 ids can matter."""
    mat = written(mat.select("row_id", "y", "x", F.lit(None).cast("string").alias("g")), "cells-mat")
    cells = Cells(_fewest(mat, ["x"], k + 1), metric, cell_rows, rows=mat)
    asked = mat.groupBy("x").agg(F.min("row_id").alias("qid"))
    found = cells.nearest(asked.select("qid", F.lit(None).cast("string").alias("g"), "x"), k + 1)
    if log is not None:
        log.append((cells.visits, len(cells.geometry.count)))
    back = mat.select("row_id", "x").join(asked, "x").select("row_id", "qid")
    joined = back.join(found.drop("rank"), "qid").where(F.col("id") != F.col("row_id"))
    place = F.row_number().over(Window.partitionBy("row_id").orderBy("d", "id"))
    return joined.withColumn("rank", place).where(F.col("rank") <= k).select("row_id", "rank", "id", "d", "y")


def nearest_own(mat: DataFrame, metric: str = "euclidean", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(row_id, d): distance to the nearest OTHER row of the group of every row
    of ``mat`` (row_id, g, x) that has one."""
    mat = written(mat.select("row_id", F.col("g").alias("y"), "x", "g"), "cells-mat")
    cells = Cells(_fewest(mat, ["x", "g"], 2), metric, cell_rows, rows=mat)
    asked = mat.groupBy("x", "g").agg(F.min("row_id").alias("qid"))
    found = cells.nearest(asked.select("qid", "g", "x"), 2, own=True)
    back = mat.select("row_id", "x", "g").join(asked, ["x", "g"]).select("row_id", "qid")
    return back.join(found, "qid").where(F.col("id") != F.col("row_id")).groupBy("row_id").agg(F.min("d").alias("d"))


def nearest_in(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(row_id, rank, id, d, y): the k nearest rows of ``points`` (row_id, y, x)
    for every row of ``queries`` (row_id, x)."""
    none = F.lit(None).cast("string").alias("g")
    cells = Cells(_fewest(points.select("row_id", "y", "x", none), ["x"], k), metric, cell_rows)
    queries = written(queries.select("row_id", "x"), "cells-queries")
    asked = queries.groupBy("x").agg(F.min("row_id").alias("qid"))
    found = cells.nearest(asked.select("qid", none, "x"), k)
    return queries.join(asked, "x").select("row_id", "qid").join(found, "qid").drop("qid")


class Enemies:
    """Nearest rows of another group, for groups that change between searches
    while the rows (row_id, x) and their cells stay.  With ``positive``, rows
    at distance zero are no neighbours."""

    def __init__(self, mat: DataFrame, metric: str, cell_rows: int = CELL_ROWS, positive: bool = False):
        none = F.lit(None).cast("string")
        self.cells = Cells(mat.select("row_id", none.alias("y"), none.alias("g"), "x"), metric, cell_rows)
        self.dealt, self.positive = self.cells.points.select("row_id", "x", "cell"), positive

    def nearest(self, groups: DataFrame) -> DataFrame:
        """(row_id, g, ne_id, ne_d) of the rows that have one; ``groups`` is
        (row_id, g).  Of equal rows the first of a group stands for it, and of
        the groups there two are enough to find one that is another."""
        rows = written(self.dealt.join(groups.select("row_id", F.col("g").cast("string").alias("g")), "row_id"), "cells-groups")
        one = written(rows.groupBy("x", "g").agg(F.min("row_id").alias("row_id"), F.first("cell").alias("cell")), "cells-one")
        self.cells.points = written(_fewest(one, ["x"], 2).select("row_id", F.col("g").alias("y"), "g", "x", "cell"), "cells-points")
        found = self.cells.nearest(one.select(F.col("row_id").alias("qid"), "g", "x"), 1, by_group=True, positive=self.positive)
        key = rows.join(one.select("x", "g", F.col("row_id").alias("qid")), ["x", "g"]).select("row_id", "g", "qid")
        return key.join(found.select("qid", F.col("id").alias("ne_id"), F.col("d").alias("ne_d")), "qid").select("row_id", "g", "ne_id", "ne_d")


def density_clusters(mat: DataFrame, eps: float, min_samples: int, metric: str = "euclidean", cell_rows: int = CELL_ROWS,
                     log: list | None = None) -> DataFrame:
    """(row_id, root): the smallest row of each row's density cluster, null for
    noise.

    Cells that reach within ``eps`` of a row are joined to it by equal cell
    number, twice: once to count neighbours, once to link.  A tile of links
    returns a spanning forest of its core points and, of border points, the
    forest's trees they touch.  One contraction of the links gives the
    clusters; a border row takes the smallest of its clusters.  Equal rows are
    one point with a weight.
    """
    mat = written(mat.select("row_id", "x"), "cells-mat")
    point = written(mat.groupBy("x").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("w")), "cells-distinct")
    cells = Cells(point.select("row_id", F.col("w").cast("string").alias("y"), F.lit(None).cast("string").alias("g"), "x"), metric, cell_rows, rows=point)
    asked = point.select(F.col("row_id").alias("qid"), F.lit(None).cast("string").alias("g"), "x", F.lit(float(eps)).alias("limit"))

    def count(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(residents):
            return pd.DataFrame({"qid": [], "w": []})
        R, w, out = _matrix(residents["x"]), residents["y"].astype("int64").to_numpy(), []
        for a in range(0, len(visitors), _CHUNK):
            part = visitors.iloc[a:a + _CHUNK]
            out.append(pd.DataFrame({"qid": part["qid"], "w": (_dist(_matrix(part["x"]), R, metric) <= eps) @ w}))
        return pd.concat(out, ignore_index=True)

    visits = written(cells._to_visit(asked, 0, None, False), "cells-visits")
    dense = written(cells._meet(visits, count, "qid long, w long").groupBy("qid").agg(F.sum("w").alias("w")).select(
        "qid", (F.col("w") >= min_samples).alias("core")), "cells-dense")
    # the mark of a core point travels as its group
    cells.points = written(cells.points.drop("g").join(dense.select(F.col("qid").alias("row_id"), F.when(F.col("core"), "core").alias("g")), "row_id").where(
        "g is not null").select("row_id", "y", "g", "x", "cell"), "cells-points")
    marked = visits.drop("g").join(dense.select("qid", F.when(F.col("core"), "core").alias("g")), "qid").select("qid", "g", "x", "limit", "cell")

    def link(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(residents):
            return pd.DataFrame({"a": [], "b": [], "core": []})
        R, ids = _matrix(residents["x"]), residents["row_id"].to_numpy()
        core = (visitors["g"] == "core").to_numpy()
        qid, near = visitors["qid"].to_numpy(), []
        for a in range(0, len(visitors), _CHUNK):
            near.append(_dist(_matrix(visitors["x"].iloc[a:a + _CHUNK]), R, metric) <= eps)
        near = np.concatenate(near)
        # smallest label of a tree, handed to and fro between visitors and residents
        label, seen = ids.copy(), None
        big = np.iinfo(np.int64).max
        mine = near[core]
        own = qid[core].copy()
        while seen is None or (label != seen).any():
            seen = label.copy()
            for a in range(0, len(mine), _CHUNK):
                own[a:a + _CHUNK] = np.minimum(own[a:a + _CHUNK], np.where(mine[a:a + _CHUNK], label[None, :], big).min(1))
            for a in range(0, len(mine), _CHUNK):
                label = np.minimum(label, np.where(mine[a:a + _CHUNK], own[a:a + _CHUNK, None], big).min(0))
        out = [pd.DataFrame({"a": np.concatenate([qid[core], ids]), "b": np.concatenate([own, label]), "core": True})]
        row, col = np.nonzero(near[~core])
        touched = np.unique(np.stack([qid[~core][row], label[col]]), axis=1)
        out.append(pd.DataFrame({"a": touched[0], "b": touched[1], "core": False}))
        return pd.concat(out, ignore_index=True)

    links = written(cells._meet(marked, link, "a long, b long, core boolean").distinct(), "cells-links")
    if log is not None:
        log.append((cells.visits, len(cells.geometry.count)))
    roots = connected_components(links.where("core").select("a", "b"))
    core = dense.where("core").select(F.col("qid").alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    border = links.where(~F.col("core")).select(F.col("a").alias("of"), F.col("b").alias("node")).join(core, "node").groupBy("of").agg(F.min("root").alias("root"))
    found = core.unionByName(border.select(F.col("of").alias("node"), "root"))
    back = mat.join(point.select("x", F.col("row_id").alias("node")), "x").select("row_id", "node")
    return back.join(found, "node", "left").select("row_id", "root")
