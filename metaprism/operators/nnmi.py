"""Mutual information of numeric columns with a numeric target (P34, regression)
by nearest neighbours (Kraskov, Stoegbauer and Grassberger 2004, first estimator).

For every row, r is the Chebyshev distance to its k-th neighbour in the plane of
column and target; with n_x and n_y the rows nearer than r along each axis (the
row itself included), the score is psi(n) + psi(k) - mean(psi(n_x) + psi(n_y)).
Both axes have unit deviation and a jitter of about 1e-10, so ties have an order.

* All columns go at once: rows (column, id, x, y) are range-partitioned by x and,
  among equal x, by y, and written once.  A partition is a box of the plane; a
  value that many rows share is cut by y, so no partition grows with it.
* A row finds its neighbours in its own box.  Only rows whose k-th distance
  reaches another box visit the two nearest ones, then all that the smaller
  distance reaches; a box sends what the visitors of a side can reach.
* n_x and n_y are counted among the values of a range of the axis; only ends of
  intervals outside of the range are looked up, in bounds that the driver keeps
  or, inside a run of values, in that run.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..frame import Frame, NotComputable, collect_bounded, keyed
from ..session import ensure_checkpoint_dir, written

#: Rows of a partition, about; of a range of one axis.
BOX_ROWS = 65_536
LINE_ROWS = 262_144
#: Rows of a batch that a task returns, runs of values of a range that the driver lists.
OUT_ROWS, RUNS = 16_384, 64
#: Boxes that a partition is cut into, at most.
SUB = 16
#: Boxes of all columns that the driver lists.
MAX_BOXES = 1_000_000
JITTER = 1e-10
EULER = 0.5772156649015329


def digamma_of_counts(m: Column) -> Column:
    """psi(m) of whole numbers m >= 1: harmonic sums below 10, else the
    asymptotic series (error under 1e-12)."""
    small = F.array(*[F.lit(sum(1.0 / j for j in range(1, i)) - EULER) for i in range(1, 10)])
    x = m.cast("double")
    z = 1.0 / (x * x)
    series = F.ln(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))
    return F.when(m < 10, F.get(small, (m - 1).cast("int"))).otherwise(series)


def _digamma(m: int) -> float:
    if m < 10:
        return sum(1.0 / j for j in range(1, m)) - EULER
    z = 1.0 / (m * m)
    return math.log(m) - 0.5 / m - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def _normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw of the keys."""
    def uniform(salt):
        return (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.ln(uniform("radius"))) * F.cos(2.0 * math.pi * uniform("angle"))


def plane_rows(fr: Frame, target: str, cols: list[str], seed: int = 0) -> DataFrame:
    """(attr, id, raw, x, y) of every column: scaled to unit deviation, jittered.
    Rows where the column or the target is null or NaN are not of that column."""
    fr = keyed(fr)

    def clean(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)
    both = {c: clean(c).isNotNull() & clean(target).isNotNull() for c in cols}
    aggs = [F.stddev_pop(F.when(both[c], clean(v))).alias(f"{w}sd{i}") for i, c in enumerate(cols) for w, v in (("x", c), ("y", target))]
    aggs += [F.avg(F.when(both[c], F.abs(clean(v)))).alias(f"{w}mean{i}") for i, c in enumerate(cols) for w, v in (("x", c), ("y", target))]
    fit = fr.df.agg(*aggs).first()
    cells = []
    for i, c in enumerate(cols):
        scaled = {}
        for w, v in (("x", c), ("y", target)):
            sd = fit[f"{w}sd{i}"] or 1.0  # a constant keeps its scale
            size = JITTER * max(1.0, (fit[f"{w}mean{i}"] or 0.0) / sd)
            scaled[w] = clean(v) / F.lit(sd) + F.lit(size) * _normal(seed, F.lit(v), F.col(fr.row_id))
        cells.append(F.when(both[c], F.struct(F.lit(i).alias("attr"), F.col(fr.row_id).alias("id"), clean(c).alias("raw"),
                                              scaled["x"].alias("x"), scaled["y"].alias("y"))))
    return fr.df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")


def nearest(pa, pb, qa, qb, left, right, k: int, limit=np.inf) -> np.ndarray:
    """The k smallest Chebyshev distances (ascending, inf where fewer) of queries
    to points sorted by ``pa``.  Queries look at the points from ``left`` down and
    from ``right`` up until the first coordinate alone is too far.  Distances of
    ``limit`` and more are inf."""
    limit = np.broadcast_to(limit, len(qa))[:, None]
    best = np.repeat(limit, k, axis=1)
    open_ = [left >= 0, right < len(pa)]
    step = 0
    while open_[0].any() or open_[1].any():
        for side, start, way in ((0, left, -1), (1, right, 1)):
            who = np.flatnonzero(open_[side])
            if not len(who):
                continue
            at = start[who] + way * step
            along = np.abs(pa[at] - qa[who])
            d = np.maximum(along, np.abs(pb[at] - qb[who]))
            nearer = d < best[who, -1]
            rows = who[nearer]
            best[rows, -1] = d[nearer]
            best[rows] = np.sort(best[rows], axis=1)
            following = at + way
            open_[side][who] = (along < best[who, -1]) & (following >= 0) & (following < len(pa))
        step += 1
    return np.where(best < limit, best, np.inf)


def _sorted_points(x: np.ndarray, y: np.ndarray):
    """Coordinates sorted along the axis of the larger span, whether that is x, order."""
    along_x = bool(np.ptp(x) >= np.ptp(y))
    a, b = (x, y) if along_x else (y, x)
    order = np.argsort(a, kind="stable")
    return a[order], b[order], along_x, order


def _lists(best: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32)), pa.array(best.ravel()))


def _last(near: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    """(rows, k) of a column of lists of k numbers."""
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    return near.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _own(k: int, schema: pa.Schema):
    """Rows of a partition -> the same rows with their k nearest of the partition and
    column; ``_pid`` becomes the box: a partition is cut at wide gaps of x, so that
    the end of one value and the start of the next do not span both."""
    def run(batches):
        table = pa.Table.from_batches(list(batches), schema)
        attrs = table["attr"].to_numpy()
        for attr in np.unique(attrs):
            one = table.filter(pa.array(attrs == attr))
            a, b, _, order = _sorted_points(one["x"].to_numpy(), one["y"].to_numpy())
            i = np.arange(len(a))
            best = nearest(a, b, a, b, i - 1, i + 1, k)
            one = one.take(pa.array(order))
            along = np.sort(one["x"].to_numpy())
            step = np.diff(along)
            wide = np.argsort(step, kind="stable")[::-1][:SUB - 1]
            cuts = np.sort(along[wide[step[wide] > 0.01 * np.ptp(along)] + 1])
            box = one["_pid"].to_numpy() * SUB + np.searchsorted(cuts, one["x"].to_numpy(), "right")
            one = one.set_column(one.column_names.index("_pid"), "_pid", pa.array(box.astype(np.int32)))
            yield from one.append_column("near", _lists(best)).to_batches(OUT_ROWS)
    return run


def _visit(k: int):
    def run(key, visitors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(points):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("attr", "id", "near")})
        a, b, along_x, _ = _sorted_points(points["x"].to_numpy(float), points["y"].to_numpy(float))
        q = ("x", "y") if along_x else ("y", "x")
        qa, qb = visitors[q[0]].to_numpy(float), visitors[q[1]].to_numpy(float)
        at = np.searchsorted(a, qa)
        return pd.DataFrame({"attr": visitors["attr"].to_numpy(), "id": visitors["id"].to_numpy(),
                             "near": list(nearest(a, b, qa, qb, at - 1, at, k, visitors["r"].to_numpy(float)))})
    return run


def _gaps(box: np.ndarray, x, y, r, pid):
    """For slices of rows: (rows, boxes, distance of every row to every box) with
    the boxes that may be nearer than a row's r, in the order of ``box``."""
    order = np.argsort(r, kind="stable")
    at = 0
    while at < len(order):
        i = order[at:at + 2048]
        most = r[i[-1]]
        near = np.flatnonzero((box[:, 1] < x[i].max() + most) & (box[:, 2] > x[i].min() - most)
                              & (box[:, 3] < y[i].max() + most) & (box[:, 4] > y[i].min() - most))
        i = i[:max(1, 2_000_000 // max(1, len(near)))]
        at += len(i)
        b = box[near]
        gap = np.maximum(np.maximum(b[:, 1] - x[i, None], x[i, None] - b[:, 2]), np.maximum(b[:, 3] - y[i, None], y[i, None] - b[:, 4]))
        gap = np.maximum(gap, 0.0)
        gap[pid[i, None] // SUB == b[None, :, 0] // SUB] = np.inf
        yield i, near, gap


def _open(boxes: dict[int, np.ndarray], k: int):
    """Rows with ``open``: whether another box is nearer than the k-th distance."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            attrs, pid, x, y = (table[c].to_numpy() for c in ("attr", "_pid", "x", "y"))
            r = _last(table["near"], k)[:, -1]
            found = np.zeros(len(r), bool)
            for attr in np.unique(attrs):
                mine = np.flatnonzero(attrs == attr)
                for i, _, gap in _gaps(boxes[attr], x[mine], y[mine], r[mine], pid[mine]):
                    found[mine[i]] = (gap < r[mine[i], None]).any(1)
            out = table.drop_columns(["near"]).append_column("r", pa.array(r))
            out = out.append_column("near", pc.if_else(pa.array(found), table["near"], pa.scalar(None, table["near"].type)))
            yield from out.append_column("open", pa.array(found)).to_batches()
    return run


def _reach(boxes: dict[int, np.ndarray], first: int | None, skip: int):
    """Rows -> one row a box to visit, nearest boxes first: the ``first`` nearest
    other boxes nearer than the k-th distance, or all but the ``skip`` nearest.
    ``side``: whether the box lies before or after the row's own."""
    columns = ("attr", "id", "x", "y", "r", "to", "side")

    def run(batches):
        for pdf in batches:
            out = []
            for attr, rows in pdf.groupby("attr"):
                box = boxes[attr]  # pid, x0, x1, y0, y1
                r = np.array([v[-1] for v in rows["near"]])
                x, y, pid = rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["_pid"].to_numpy()
                for e, near, gap in _gaps(box, x, y, r, pid):
                    rank = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1)
                    go = (gap < r[e, None]) & (rank >= skip) & (rank < (first if first is not None else len(box)))
                    i, j = np.nonzero(go)
                    part = rows.iloc[e[i]][["attr", "id", "x", "y"]].copy()
                    part["r"] = r[e[i]]
                    part["to"] = box[near[j], 0].astype("int32")
                    part["side"] = (part["to"].to_numpy() > pid[e[i]]).astype("int32")
                    out.append(part)
            yield pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
    return run


def _hulled(points: DataFrame, visits: DataFrame, by: list[str], axes: dict[str, tuple[Column, Column]], names: str) -> DataFrame:
    """``points`` (.., _pid) that lie within what the visitors of their box ask
    for, once for either side that they come from."""
    lows = [F.min(lo).alias(f"_l{c}") for c, (lo, _) in axes.items()]
    highs = [F.max(hi).alias(f"_h{c}") for c, (_, hi) in axes.items()]
    hull = visits.groupBy(*by, F.col("to").alias("_pid"), "side").agg(*lows, *highs)
    hull = hull.sparkSession.createDataFrame(collect_bounded(hull, names, MAX_BOXES), hull.schema)
    inside = [F.col(c).between(F.col(f"_l{c}"), F.col(f"_h{c}")) for c in axes]
    return points.join(F.broadcast(hull), [*by, "_pid"]).where(reduce(lambda p, q: p & q, inside)).select(*by, "_pid", "side", *axes)


def radii(rows: DataFrame, k: int, box_rows: int = BOX_ROWS) -> DataFrame:
    """(attr, id, x, y, r): distance to the k-th neighbour in the plane, inf for
    columns of k rows or fewer; written."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // box_rows))
    ranged = (rows.repartitionByRange(parts, "attr", "raw", "y").select("attr", "id", "x", "y", F.spark_partition_id().alias("_pid")))
    id_type = ranged.schema["id"].dataType.simpleString()
    base = f"attr int, id {id_type}, x double, y double, _pid int"
    # plain arrow types of the columns, as an empty partition has no batch to tell them
    own = written(ranged.mapInArrow(_own(k, to_arrow_schema(ranged.schema)), f"{base}, near array<double>"), "nnmi-own")
    found = collect_bounded(own.groupBy("attr", "_pid").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")), "boxes", MAX_BOXES)
    boxes: dict = {}
    for attr, *box in sorted(found):
        boxes.setdefault(attr, []).append(box)
    boxes = {a: np.array(b, float) for a, b in boxes.items()}
    marked = written(own.mapInArrow(_open(boxes, k), f"{base}, r double, near array<double>, open boolean"), "nnmi-marked")
    state = marked.where("open").select("attr", "id", "x", "y", "_pid", "near")
    for first, skip in ((2, 0), (None, 2)):
        visits = written(state.mapInPandas(_reach(boxes, first, skip), f"attr int, id {id_type}, x double, y double, r double, to int, side int"), "nnmi-visits")
        square = {c: (F.col(c) - F.col("r"), F.col(c) + F.col("r")) for c in ("x", "y")}
        keys = ["_pid", "side", "attr"]
        there = (visits.withColumnRenamed("to", "_pid").groupBy(*keys)
                 .cogroup(_hulled(own, visits, ["attr"], square, "visited boxes").groupBy(*keys))
                 .applyInPandas(_visit(k), f"attr int, id {id_type}, near array<double>"))
        empty = F.lit(None)
        both = state.unionByName(there.select("attr", "id", empty.cast("double").alias("x"), empty.cast("double").alias("y"),
                                              empty.cast("int").alias("_pid"), "near"))
        # at most k numbers a visited box
        state = written(both.groupBy("attr", "id").agg(
            F.max("x").alias("x"), F.max("y").alias("y"), F.max("_pid").alias("_pid"),
            F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")), "nnmi-open")
    closed = marked.where(~F.col("open")).select("attr", "id", "x", "y", "r")
    return closed.unionByName(state.select("attr", "id", "x", "y", F.col("near")[k - 1].alias("r")))


def _half(v, r):
    """Half the length of a row's interval, drawn in by four units in the last
    place, so that the k-th neighbour itself, at r along one axis, is not counted."""
    return np.maximum(r - 4 * 2.0 ** -52 * np.maximum(np.abs(v), r), 0.0)


def _count_here(schema: pa.Schema, most: int):
    """Rows (line, id, v, r) of a range of values -> (line, id, v, m, lo, hi, n):
    values of the range within the row's interval, and the interval's ends (else
    null) that other ranges may have values of; also, with a null id, runs of values between
    the range's widest gaps (``most`` of them): least value ``lo``, greatest ``hi``, number ``n``."""
    def run(batches):
        table = pa.Table.from_batches(list(batches), schema)
        lines = table["line"].to_numpy()
        for line in np.unique(lines):
            one = table.filter(pa.array(lines == line))
            v = one["v"].to_numpy()
            order = np.argsort(v, kind="stable")
            v, r, ids = v[order], one["r"].to_numpy()[order], one["id"].take(pa.array(order))
            half = _half(v, r)
            lo, hi = v - half, v + half
            left, right = np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")
            none = np.zeros(len(v), np.int64)
            yield from pa.table({"line": np.full(len(v), line, np.int32), "id": ids, "v": v, "m": (right - left).astype(np.int64),
                                 "lo": pa.array(lo, mask=left > 0), "hi": pa.array(hi, mask=right < len(v)), "n": none}).to_batches(OUT_ROWS)
            step = np.diff(v)
            cut = np.sort(np.argpartition(step, -min(len(step), most - 1))[-(most - 1):]) + 1 if len(step) else np.zeros(0, int)
            start, end = np.r_[0, cut], np.r_[cut, len(v)]
            k = len(start)
            yield from pa.table({"line": np.full(k, line, np.int32), "id": pa.nulls(k, ids.type), "v": pa.nulls(k, pa.float64()), "m": pa.nulls(k, pa.int64()),
                                 "lo": v[start], "hi": v[end - 1], "n": (end - start).astype(np.int64)}).to_batches()
    return run


def _elsewhere(runs: dict[int, tuple], schema: pa.Schema):
    """Rows with ends beyond their range -> (line, id, m, at, to, end, kind): m grows
    by what whole runs tell (kind -1: that is all), a row more for every end inside a
    run ``at`` of the range ``to`` (kind 0: lower, 1: upper; the row itself is kind -2)."""
    def run(batches):
        for batch in batches:
            lines, pids, counted = (batch[c].to_numpy() for c in ("line", "_pid", "m"))
            for line in np.unique(lines):
                least, most, before, pid = runs[line]
                mine = np.flatnonzero(lines == line)
                ids, m = batch["id"].take(pa.array(mine)), counted[mine].copy()
                first, past = np.searchsorted(pid, pids[mine], "left"), np.searchsorted(pid, pids[mine], "right")
                kinds, ends = np.full(len(m), -1, np.int32), []
                for name, kind in (("lo", 0), ("hi", 1)):
                    e = batch[name].to_numpy(zero_copy_only=False)[mine]
                    has = ~np.isnan(e)
                    if kind == 0:  # values of earlier ranges that are not below the end
                        at = np.searchsorted(most, e, "left")
                        m[has] += (before[first] - before[np.minimum(at, first)])[has]
                        inside = has & (at < first) & (least[np.minimum(at, len(least) - 1)] < e)
                    else:  # values of later ranges that are not above it
                        at = np.searchsorted(least, e, "right")
                        m[has] += (before[np.maximum(at, past)] - before[past])[has]
                        at = at - 1
                        inside = has & (at >= past) & (most[np.maximum(at, 0)] > e)
                    kinds[inside] = -2
                    w = np.flatnonzero(inside)
                    ends.append((ids.take(pa.array(w)), np.zeros(len(w), np.int64), at[w], pid[at[w]], e[w], np.full(len(w), kind)))
                none = np.full(len(m), -1)
                for i, count, at, to, end, kind in ((ids, m, none, none, np.full(len(m), np.nan), kinds), *ends):
                    yield from pa.table([pa.array(np.full(len(i), line)), i, *map(pa.array, (count, at, to, end, kind))],
                                        names=schema.names).cast(schema).to_batches()
    return run


def _take_off(runs: dict[int, tuple]):
    """Of the run that an end lies in, the values beyond the end, which do not count."""
    def run(key, visitors: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("line", "id", "m")})
        line = int(visitors["line"].iloc[0])
        least, most, *_ = runs[line]
        v, at = np.sort(points["v"].to_numpy(float)), visitors["at"].to_numpy()
        e, low = visitors["end"].to_numpy(float), visitors["kind"].to_numpy() == 0
        # only values of the run between its start (end) and the farthest end asked for are here
        off = np.where(low, np.searchsorted(v, e, "left") - np.searchsorted(v, least[at], "left"),
                       np.searchsorted(v, most[at], "right") - np.searchsorted(v, e, "right"))
        return pd.DataFrame({"line": visitors["line"].to_numpy(), "id": visitors["id"].to_numpy(), "m": -off})
    return run


def line_counts(near: DataFrame, most_runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """(line, id, m) in two tables, the rows whose interval ends in no run of
    another range, and the others; line = 2 attr, plus 1 for y.

    Values are dealt to ranges, where a row counts the values of its interval.
    Ranges beyond it count whole, as runs (at most ``most_runs`` a range, two or
    more) between the widest gaps tell; an end inside a run is asked of that
    run's values."""
    spark = near.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * near.count() // LINE_ROWS))
    lines = near.select("id", "r", F.inline(F.array(*[F.struct((F.col("attr") * 2 + i).alias("line"), F.col(c).alias("v")) for i, c in enumerate("xy")])))
    ranged = lines.repartitionByRange(parts, "line", "v").select("line", "id", "v", "r")
    id_type = ranged.schema["id"].dataType.simpleString()
    here = written(ranged.mapInArrow(_count_here(to_arrow_schema(ranged.schema), most_runs), f"line int, id {id_type}, v double, m long, lo double, hi double, n long")
                   .withColumn("_pid", F.spark_partition_id()), "nnmi-lines")
    runs: dict = {}
    found = collect_bounded(here.where("id IS NULL").select("line", "lo", "hi", "n", "_pid"), "runs of values", MAX_BOXES)
    for line in {t["line"] for t in found}:
        mine = sorted((t["lo"], t["hi"], t["n"], t["_pid"]) for t in found if t["line"] == line)
        least, most, n, pid = (np.array(c) for c in zip(*mine))
        runs[line] = (least, most, np.r_[0, np.cumsum(n)], pid)
    rows = here.where("id IS NOT NULL")
    beyond = rows.where("lo IS NOT NULL OR hi IS NOT NULL")
    asked = f"line int, id {id_type}, m long, at int, to int, end double, kind int"
    plain = to_arrow_schema(spark.createDataFrame([], asked).schema)
    asked = written(beyond.mapInArrow(_elsewhere(runs, plain), asked), "nnmi-ends")
    ends = asked.where("kind >= 0").withColumn("side", F.col("kind"))
    # a lower end takes off from the start of its run, an upper end from the run's end
    spans = [(int(line), int(a), float(x), float(y)) for line, (least, most, *_) in runs.items() for a, (x, y) in enumerate(zip(least, most))]
    span = spark.createDataFrame(spans, "line int, at int, _a double, _b double")
    ends = ends.join(F.broadcast(span), ["line", "at"])
    reach = {"v": (F.when(F.col("kind") == 0, F.col("_a")).otherwise(F.col("end")), F.when(F.col("kind") == 0, F.col("end")).otherwise(F.col("_b")))}
    values = _hulled(rows, ends, ["line"], reach, "visited ranges")
    keys = ["line", "_pid", "side"]
    off = (ends.withColumnRenamed("to", "_pid").select("line", "_pid", "side", "id", "at", "end", "kind").groupBy(*keys)
           .cogroup(values.groupBy(*keys)).applyInPandas(_take_off(runs), f"line int, id {id_type}, m long"))
    known = rows.where("lo IS NULL AND hi IS NULL").unionByName(asked.where("kind = -1"), allowMissingColumns=True).select("line", "id", "m")
    far = asked.where("kind = -2").select("line", "id", "m").unionByName(off).groupBy("line", "id").agg(F.sum("m").alias("m"))
    return known, far


def axis_counts(near: DataFrame, most_runs: int = RUNS) -> DataFrame:
    """(attr, id, axis, m): rows nearer than r along an axis, the row itself
    included."""
    here, far = line_counts(near, most_runs)
    line = F.col("line")
    return here.unionByName(far).select((line / 2).cast("int").alias("attr"), "id", F.when(line % 2 == 0, "x").otherwise("y").alias("axis"), "m")


def mutual_info_numeric(fr: Frame, cols: list[str] | None = None, k: int = 3, seed: int = 0,
                        box_rows: int = BOX_ROWS) -> DataFrame:
    """(attr, mi) in nats of numeric columns with the numeric label, at least 0.
    Columns of k rows or fewer have NaN."""
    if fr.label is None:
        raise NotComputable("mutual information needs a target")
    cols = list(fr.num if cols is None else cols)
    schema = "attr string, mi double"
    if not cols:
        return fr.spark.createDataFrame([], schema)
    near = radii(plane_rows(fr, fr.label, cols, seed), k, box_rows)
    sums = axis_counts(near.where(F.col("r") < float("inf"))).groupBy("attr", "axis").agg(
        F.count("*").alias("n"), F.avg(digamma_of_counts(F.col("m"))).alias("psi")).collect()  # two rows a column
    score: dict = {}
    for r in sums:
        score.setdefault(r["attr"], _digamma(r["n"]) + _digamma(k))
        score[r["attr"]] -= r["psi"]
    rows = [(c, max(0.0, score[i]) if i in score else float("nan")) for i, c in enumerate(cols)]
    return fr.spark.createDataFrame(rows, schema)
