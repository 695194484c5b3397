"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints collapse first.  Distinct fingerprints lie in cells by the
bit counts of their four 16-bit words; two fingerprints within the radius have
bit counts that differ by no more than the radius in total, so only such cell
pairs are compared, tile by tile, with numpy exclusive-or and bit counts.
Every other tile pair is skipped, nothing else is.
"""

from __future__ import annotations

from itertools import product
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise

WORDS = 4
#: Fingerprints of one cell that a tile holds at most (expected, by hash).
TILE_ROWS = 4096
_CHUNK = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles: a bit is 1 if set in more than half
    of the shingles' XXH64 (seed 42).  No word: 0; fewer words than a shingle:
    the whole sequence is the one shingle."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:a + _CHUNK], stops[a:a + _CHUNK])], np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for b in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            set_bits += bits[b:b + 255].sum(axis=0, dtype=np.uint8)
    value = np.packbits(2 * set_bits > n).tobytes()
    return int.from_bytes(value, "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long (Arrow batches)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts.tolist()], np.uint64).view(np.int64))
    return F.pandas_udf(run, "long").asNondeterministic()(text)


def _counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four words, most significant first, as (n, 4)."""
    return np.bitwise_count(fp.astype(">u8").view(">u2").reshape(-1, WORDS).astype(np.uint16)).astype(np.int64)


def _pack(c: np.ndarray) -> np.ndarray:
    return ((c[:, 0] * 17 + c[:, 1]) * 17 + c[:, 2]) * 17 + c[:, 3]


def _offsets(radius: int) -> list:
    """Cell steps to itself and to later cells whose bit counts differ by at
    most ``radius`` in total."""
    reach = range(-radius, radius + 1)
    return [o for o in product(reach, repeat=WORDS) if sum(map(abs, o)) <= radius and o >= (0,) * WORDS]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: every node with the
    smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(own: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs of one tile with its visitors that are within the
    radius; works in blocks of a million bit counts."""
    a, b = own.view(np.uint64), other.view(np.uint64)
    left, right, held = [], [], 0
    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        near = np.bitwise_count(a[k:k + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = own[k + i], other[j]
        keep = x != y
        left.append(x[keep])
        right.append(y[keep])
        held += int(keep.sum())
        if held > 1 << 20:
            x, y = _forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [x], [y], len(x)
    return _forest(np.concatenate(left), np.concatenate(right)) if held else (own[:0], own[:0])


def links(fps: DataFrame, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect the
    same fingerprints as all pairs within ``radius`` bits.

    A cell's fingerprints are cut into tiles by hash, and those that may be in
    reach (of the cell and of later cells) into chunks; each tile meets each
    chunk in one task and sends a spanning forest of its links.
    """
    def cell_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(_pack(_counts(s.to_numpy().view(np.uint64))))

    celled = materialise(fps.select("fp", F.pandas_udf(cell_of, "long").asNondeterministic()("fp").alias("cell")), "simhash-cells")
    n = np.zeros(17 ** WORDS, np.int64)
    for r in celled.groupBy("cell").count().collect():  # at most 17^4 cells, whatever the input
        n[r["cell"]] = r["count"]
    steps = np.array(_offsets(radius))
    cells = np.nonzero(n)[0]
    grid = np.stack([cells // 17 ** 3, cells // 289 % 17, cells // 17 % 17, cells % 17], axis=1)
    visits = np.zeros_like(n)
    for o in steps:
        to = grid + o
        fits = ((to >= 0) & (to <= 16)).all(axis=1)
        visits[cells[fits]] += n[_pack(to[fits])]
    tiles, chunks = -(-n // tile_rows), -(-visits // (8 * tile_rows))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, cell = batch["fp"].to_numpy(), batch["cell"].to_numpy()
            u = fp.view(np.uint64)
            mix = ((u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            mix = mix.astype(np.int64)
            counts, out = _counts(u), []

            def copies(rows, to, fixed, reps, visitor):
                """One copy for each tile (visitor) or chunk (own) of cell ``to``."""
                at = np.repeat(np.arange(len(rows)), reps)
                run = np.arange(len(at)) - (np.cumsum(reps) - reps)[at]
                tile, chunk = (run, fixed[at]) if visitor else (fixed[at], run)
                out.append(pd.DataFrame({"cell": to[at], "tile": tile, "chunk": chunk, "visitor": visitor, "fp": fp[rows[at]]}))

            every = np.arange(len(fp))
            copies(every, cell, mix % tiles[cell], chunks[cell], False)
            for o in steps:
                to = counts - o
                fits = ((to >= 0) & (to <= 16)).all(axis=1)
                rows = every[fits]
                home = _pack(to[fits])
                live = n[home] > 0
                rows, home = rows[live], home[live]
                copies(rows, home, mix[rows] % chunks[home], tiles[home], True)
            yield pd.concat(out, ignore_index=True)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        visitor = pdf["visitor"].to_numpy()
        fp = pdf["fp"].to_numpy()
        a, b = _compare(fp[~visitor], fp[visitor], radius)
        return pd.DataFrame({"a": a, "b": b})

    dealt = celled.mapInPandas(deal, "cell long, tile long, chunk long, visitor boolean, fp long")
    return dealt.groupBy("cell", "tile", "chunk").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link;
    alternating star contractions, each round written to the shared folder."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u <> v").distinct(), "simhash-links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = materialise(small, "simhash-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, text_hash, fp, root, component_id) per row: the component's
    smallest fingerprint and smallest id; text_hash tells rows of one id apart.

    Null and word-less texts have fingerprint zero, linked like any other;
    repeated rows and equal ids each keep their row; null ids never name a
    component unless it has no other (then it is null); an empty table gives
    no rows; other columns are never read.
    """
    prints = materialise(docs.select(F.col(id_col).alias("rid"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                                    fingerprint_column(F.col(text_col), shingle).alias("fp")),
                         "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("rid").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(distinct, radius, tile_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = materialise(rooted.join(smallest, "root").select("fp", "n", "root", "component_id"), "simhash-table")
    return lookup(prints, table, "fp", "n").select(F.col("rid").alias(id_col), "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows (all columns) that stay: one of each component, of those with
    its smallest id the one of lowest text hash."""
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    found = dedup(docs, id_col, text_col, **options)
    # null ids share one component id but not one component: the fingerprint's root tells them apart there
    stays = (found.filter(first).groupBy("root")
             .agg(F.min(F.struct("text_hash")).alias("k"), F.first("component_id").alias("rid"))
             .select("rid", "k.text_hash"))
    # one key for an id (or none) and a text; those that many rows share are broadcast, so copies without an id do not meet
    key = lambda i, h: F.concat_ws(":", F.when(i.isNull(), "null").otherwise(F.concat(F.lit("id"), i.cast("string"))), h.cast("string"))
    copies = found.groupBy(key(F.col(id_col), F.col("text_hash")).alias("__key")).agg(F.count("*").alias("n"))
    stays = materialise(stays.select(key(F.col("rid"), F.col("text_hash")).alias("__key")).distinct().join(copies, "__key"), "simhash-stays")
    rows = docs.select(F.struct("*").alias("__row"), key(F.col(id_col), F.xxhash64(F.col(text_col))).alias("__key"))
    kept = lookup(rows, stays.withColumn("__n", F.col("n")), "__key", "n")
    one = kept.filter("__n = 1").select("__row.*")
    again = kept.filter("__n > 1").dropDuplicates(["__key"]).select("__row.*")  # collapses in each task before its shuffle
    return one.unionByName(again)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The per-document result columns of the registered query."""
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
