"""Blocked Gram kernel: second moments of every pair of many columns.

A task goes once over its rows and keeps, per class, the sums that pairwise
covariances need; it emits them as tiles of ``TILE`` x ``TILE`` column pairs.
Tiles of one place are added up as a tree over the tasks, so neither a class nor
a pair of blocks meets in one task at once.  Rows are never shuffled.  Pairs are
complete by pair, as in Spark's own ``covar_samp`` and ``corr``: rows that lack
either value do not count.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns a block.
TILE = 128
#: Numbers a task may hold of all its classes before it emits its tiles.
HELD = 32_000_000
#: Parts that a group adds up on each of the first two levels.
FAN = 64

PARTS = ("n", "sx", "sy", "xy", "xx", "yy")
TILES = T.StructType([T.StructField("cls", T.StringType()), T.StructField("bi", T.IntegerType()), T.StructField("bj", T.IntegerType())]
                     + [T.StructField(p, T.BinaryType()) for p in PARTS])


class _Sums:
    """Of one class: rows without gaps are kept as vectors and one matrix, rows
    with gaps as matrices of the pairs that are there."""

    def __init__(self, d: int):
        self.n, self.s, self.q, self.c, self.gaps = 0.0, np.zeros(d), np.zeros(d), np.zeros((d, d)), None

    def add(self, x: np.ndarray, there: np.ndarray):
        whole = there.all(axis=1)
        w = x[whole]
        self.n += len(w)
        self.s += w.sum(0)
        self.q += (w * w).sum(0)
        self.c += w.T @ w
        if not whole.all():
            if self.gaps is None:
                self.gaps = [np.zeros_like(self.c) for _ in range(3)]
            m = there[~whole].astype(float)
            g = np.where(m > 0, x[~whole], 0.0)
            self.c += g.T @ g
            for total, part in zip(self.gaps, (m.T @ m, g.T @ m, (g * g).T @ m)):
                total += part

    def tiles(self, cls, size: int) -> Iterator[dict]:
        d = len(self.s)
        for bi in range(0, d, size):
            for bj in range(bi, d, size):
                i, j = slice(bi, bi + size), slice(bj, bj + size)
                out = [np.full(self.c[i, j].shape, self.n), self.s[i, None], self.s[None, j], self.c[i, j], self.q[i, None], self.q[None, j]]
                if self.gaps is not None:
                    n, s, q = self.gaps
                    out = [a + b for a, b in zip(out, (n[i, j], s[i, j], s[j, i].T, 0.0, q[i, j], q[j, i].T))]
                yield {"cls": cls, "bi": bi // size, "bj": bj // size,
                       **{p: np.ascontiguousarray(np.broadcast_to(v, out[0].shape)).tobytes() for p, v in zip(PARTS, out)}}


def _partials(shift: np.ndarray, size: int):
    d = len(shift)
    schema = pa.schema([("cls", pa.string()), ("bi", pa.int32()), ("bj", pa.int32())] + [(p, pa.binary()) for p in PARTS])

    def emit(held):
        for cls, sums in held.items():
            for tile in sums.tiles(cls, size):
                yield pa.RecordBatch.from_pylist([tile], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            flat = b.column(1).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, d) - shift
            codes, names = pd.factorize(np.array(b.column(0).to_pylist(), dtype=object), use_na_sentinel=False)
            for k, cls in enumerate(names):
                cls = cls if isinstance(cls, str) else None
                if cls not in held:
                    if held and (len(held) + 1) * d * d > HELD:
                        yield from emit(held)
                        held = {}
                    held[cls] = _Sums(d)
                held[cls].add(x[codes == k], there[codes == k])
        yield from emit(held)
    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    out = {"cls": [first["cls"]], "bi": [first["bi"]], "bj": [first["bj"]]}
    for p in PARTS:
        total = np.frombuffer(pdf[p].iloc[0]).copy()
        for b in pdf[p].iloc[1:]:
            total += np.frombuffer(b)
        out[p] = [total.tobytes()]
    return pd.DataFrame(out)


def added_up(parts: DataFrame, keys: list[str], add, schema: T.StructType) -> DataFrame:
    """The parts of each key made one by ``add``, as a tree over the tasks that
    emitted them: ``FAN`` neighbouring tasks, ``FAN`` of those, then the rest."""
    level = T.StructType([*schema.fields, T.StructField("_task", T.LongType())])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        return add(pdf).assign(_task=pdf["_task"].iloc[0])

    out = parts.withColumn("_task", F.spark_partition_id().cast("long"))
    for _ in range(2):
        out = (out.withColumn("_task", F.floor(F.col("_task") / FAN))
               .groupBy(*keys, "_task").applyInPandas(step, level))
    return out.drop("_task").groupBy(*keys).applyInPandas(lambda pdf: add(pdf), schema)


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    n, total, low, high = (np.stack([np.frombuffer(v) for v in pdf[k]]) for k in ("n", "total", "low", "high"))
    out = {"n": n.sum(0), "total": total.sum(0), "low": low.min(0), "high": high.max(0)}
    return pd.DataFrame({"one": [0], **{k: [v.tobytes()] for k, v in out.items()}})


def shifts(df: DataFrame, cols: list[str]) -> np.ndarray:
    """About the mean of each column, of a constant one its value, so that its
    deviations are exactly zero.  Values that are not finite are passed over."""
    d = len(cols)
    names = ("n", "total", "low", "high")
    layout = T.StructType([T.StructField("one", T.IntegerType())] + [T.StructField(k, T.BinaryType()) for k in names])
    schema = pa.schema([("one", pa.int32())] + [(k, pa.binary()) for k in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = np.zeros(d), np.zeros(d), np.full(d, np.inf), np.full(d, -np.inf)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            there = np.isfinite(x)
            n += there.sum(0)
            total += np.where(there, x, 0.0).sum(0)
            low = np.minimum(low, np.where(there, x, np.inf).min(0, initial=np.inf))
            high = np.maximum(high, np.where(there, x, -np.inf).max(0, initial=-np.inf))
        yield pa.RecordBatch.from_pylist([{"one": 0, **{k: v.tobytes() for k, v in zip(names, (n, total, low, high))}}], schema=schema)

    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    r = added_up(rows.mapInArrow(run, layout), ["one"], _ranges, layout).first()
    if r is None:
        return np.zeros(d)
    n, total, low, high = (np.frombuffer(r[k]) for k in names)
    with np.errstate(all="ignore"):
        pick = np.where(low == high, low, total / n)
    return np.where(np.isfinite(pick), pick, 0.0)


def tiles(df: DataFrame, cols: list[str], cls: Column | None = None, size: int = TILE,
          shift: np.ndarray | None = None) -> DataFrame:
    """(cls, bi, bj, sums as bytes): one row a class and pair of column blocks
    ``bi <= bj``, of deviations from ``shift`` (default: ``shifts``).  ``cls``
    null or not given is one class, null.  An empty table gives no rows."""
    shift = shifts(df, cols) if shift is None else shift
    cls = F.lit(None).cast("string") if cls is None else cls.cast("string")
    rows = df.select(cls.alias("cls"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    parts = rows.mapInArrow(_partials(shift, size), TILES)
    return added_up(parts, ["cls", "bi", "bj"], _add, TILES)


def _unpack(row, d: int, size: int) -> tuple[list[np.ndarray], int, int]:
    i, j = row["bi"] * size, row["bj"] * size
    shape = (min(size, d - i), min(size, d - j))
    return [np.frombuffer(row[p]).reshape(shape) for p in PARTS], i, j


def covariance(n, sx, sy, xy, xx, yy) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(n > 1, (xy - sx * sy / n) / (n - 1), np.nan)


def correlation(n, sx, sy, xy, xx, yy) -> np.ndarray:
    with np.errstate(all="ignore"):
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        return np.where((n > 1) & (vx > 0) & (vy > 0), (xy - sx * sy / n) / np.sqrt(vx * vy), np.nan)


MEASURES = {"cov": covariance, "cor": correlation}


def pair_values(df: DataFrame, cols: list[str], measure: str, size: int = TILE) -> DataFrame:
    """(i, j, value) of all pairs i > j, computed beside the tiles; no value
    (null) where Spark's own aggregate has none."""
    d, fn = len(cols), MEASURES[measure]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                parts, i, j = _unpack(row, d, size)
                v = fn(*parts)
                a, z = np.nonzero(np.arange(j, j + v.shape[1])[None, :] > np.arange(i, i + v.shape[0])[:, None])
                yield pd.DataFrame({"i": z + j, "j": a + i, "value": v[a, z]})

    return (tiles(df, cols, size=size).mapInPandas(run, "i int, j int, value double")
            .withColumn("value", F.when(~F.isnan("value"), F.col("value"))))


def covariances(df: DataFrame, cols: list[str], cls: Column | None = None, size: int = TILE) -> dict:
    """{class: (means, d x d sample covariances)} on the driver, for algebra on
    d x d matrices.  The caller bounds classes x d x d."""
    d, out, shift = len(cols), {}, shifts(df, cols)
    for row in tiles(df, cols, cls, size, shift).toLocalIterator():
        parts, i, j = _unpack(row, d, size)
        mean, m = out.setdefault(row["cls"], (np.full(d, np.nan), np.full((d, d), np.nan)))
        v = covariance(*parts)
        m[i:i + v.shape[0], j:j + v.shape[1]] = v
        m[j:j + v.shape[1], i:i + v.shape[0]] = v.T
        if i == j:
            with np.errstate(all="ignore"):
                mean[i:i + v.shape[0]] = shift[i:i + v.shape[0]] + np.diag(parts[1]) / np.diag(parts[0])
    return out
