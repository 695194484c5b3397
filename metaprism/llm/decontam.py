"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters with at most k edits keeps at least
m + 1 - q (k + 1) of the item's q-grams, all on diagonals that differ by at
most k.  Shared q-grams are counted in overlapping diagonal bands; bands that
reach the bound are verified by banded alignment.  Nothing that is within the
edit budget is missed.

The same lemma and alignment apply to overlapping windows of each item, so
that a text which keeps only a region of an item is found too.  Windows have
``REGION`` characters; an item that is no longer has windows of half its
length, at least ``WINDOW_MIN``.  A retained region of one and a half windows
holds a whole window wherever it lies, one of a window's length does where it
meets an end of the item.

The alignments of many texts run side by side, a column each.  Items too short
for a q-gram are looked up exactly, as whole words.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

Q = 10
EDIT_RATE = 0.08
#: Characters of a window; windows start every half of it, the last ends with the item.
REGION = 100
#: Least characters of a window.
WINDOW_MIN = 40
#: Least characters of an item that is looked up as whole words, being too short for a q-gram.
SHORT_MIN = 4
#: Characters of benchmark text that one pass over the documents holds.
BLOCK_CHARS = 4_000_000
#: Texts, and characters of texts, whose alignments run together.
TOGETHER, TOGETHER_CHARS = 512, 1 << 20
#: Alignments side by side, and steps after which the hopeless ones leave.
_COLUMNS, _CHECK = 2048, 8
_BITS = 22
_PIECE = 1 << 18
#: What stands around a text; no code point and unlike the filling of items.
_OUTSIDE, _FILL = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)
_P, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with white space collapsed."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, doubling their length: a hash of the first half
    times a power, plus that of the second half."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(int(_P), k, 1 << 64))
    part, length, out, done = c.astype(np.uint64), 1, None, 0
    while True:
        if q & length:  # the parts that q is the sum of, shortest first; each stands before those so far
            out = part if out is None else part[:len(part) - done] * power(done) + out[length:][:len(part) - done]
            done += length
        if length * 2 > q:
            return out[:n] * _MIX
        part = part[:-length] * power(length) + part[length:]
        length *= 2


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for an item of m characters; never so many that the lemma
    would bound nothing."""
    return max(0, min(int(m * rate), m // q - 1))


def window_of(m: int) -> int:
    """Characters of the windows of an item of m characters; m for none."""
    return REGION if m > REGION else min(m, max(WINDOW_MIN, m // 2))


@dataclass
class Block:
    """Index of some benchmark items: their codes, and their q-grams sorted by
    hash with item and position."""
    ids: np.ndarray
    codes: list
    grams: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    first: np.ndarray
    many: np.ndarray
    seen: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    window: np.ndarray
    window_edits: np.ndarray
    short: dict
    q: int
    rate: float


def build_block(items: list, q: int, rate: float) -> Block:
    codes = [codes_of(t) for _, t in items]
    grams = [_grams(c, q) for c in codes]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    uniq, first, many = np.unique(flat[order], return_index=True, return_counts=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(uniq >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    size = np.array([len(c) for c in codes], np.int64)
    window = np.array([window_of(m) for m in size.tolist()], np.int64)
    short: dict = {}
    for i, c in enumerate(codes):
        if SHORT_MIN <= len(c) < q:
            short.setdefault(len(c), {}).setdefault(int(_grams(c, len(c))[0]), []).append(i)
    return Block(np.array([i for i, _ in items], object), codes, uniq, item[order], pos[order], first, many, seen, size,
                 np.array([budget(m, q, rate) for m in size.tolist()], np.int64), window,
                 np.array([budget(m, q, rate) for m in window.tolist()], np.int64), short, q, rate)


def align(items: list, texts: list, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best occurrence of each whole item in its text on
    diagonals (text position - item position) low-k..high+k; edits are -1 where
    they exceed k.  Alignments of one width run side by side."""
    edits, end = np.full(len(items), -1), np.zeros(len(items), np.int64)
    width = high - low + 2 * k + 1
    size = np.array([len(i) for i in items], np.int64)
    order = np.lexsort((-size, width))
    edges = np.flatnonzero(np.diff(width[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        for c in range(a, b, _COLUMNS):
            some = order[c:min(c + _COLUMNS, b)]
            _side_by_side(some, items, texts, low - k, int(width[some[0]]), size, k, edits, end)
    return edits, end


def _side_by_side(some, items, texts, base, width, size, k, edits, end) -> None:
    m, first, most = size[some], base[some], k[some]
    tall = int(m.max(initial=0))
    column = np.full((tall, len(some)), _FILL, np.uint32)
    around = np.full((tall + width, len(some)), _OUTSIDE, np.uint32)
    lengths = np.array([len(texts[j]) for j in some], np.int64)
    for x, j in enumerate(some.tolist()):
        column[:m[x], x] = items[j]
        lo, hi = max(0, first[x]), min(lengths[x], first[x] + tall + width)
        if hi > lo:
            around[lo - first[x]:hi - first[x], x] = texts[j][lo:hi]
    # row[d] + d: edits of item[:i] against text ending at i + base + d; the start is free
    steps = np.arange(width, dtype=np.int32)[:, None]
    at = first + steps
    row = np.where((at >= 0) & (at <= lengths), 0, most + 1).astype(np.int32) - steps
    live = len(some)
    for i in range(1, tall + 1):
        while live and m[live - 1] < i:  # the shortest items are last
            live -= 1
        if not live:
            break
        old = row[:, :live]
        new = old + (around[i - 1:i - 1 + width, :live] != column[i - 1, :live])  # match or substitute
        np.minimum(new[:-1], old[1:] + 2, out=new[:-1])                           # item character missing in the text
        np.minimum.accumulate(new, axis=0, out=new)                               # extra text characters
        row[:, :live] = new
        over = np.flatnonzero(m[:live] == i)
        if len(over):
            real = new[:, over] + steps
            best, d = real.min(0), real.argmin(0)
            good = best <= most[over]
            edits[some[over[good]]] = best[good]
            end[some[over[good]]] = first[over[good]] + i + d[good]
        if i % _CHECK == 0:
            stay = (row + steps).min(0) <= most
            if 2 * stay.sum() < len(stay):
                some, m, first, most, row, column, around = some[stay], m[stay], first[stay], most[stay], row[:, stay], column[:, stay], around[:, stay]
                live = int((m >= i).sum())


def _hits(c: np.ndarray, block: Block):
    """(item, position in the item, diagonal) of every shared q-gram; None
    where there is none."""
    q, hits_item, hits_pos, hits_diag = block.q, [], [], []
    for a in range(0, max(len(c) - q + 1, 0), _PIECE):  # long texts piece by piece
        h = _grams(c[a:a + _PIECE + q - 1], q)
        at = np.nonzero(block.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])[0]
        if not len(at) or not len(block.grams):
            continue
        h = h[at]
        ix = np.minimum(np.searchsorted(block.grams, h), len(block.grams) - 1)
        same = block.grams[ix] == h
        at, ix = at[same] + a, ix[same]
        many = block.many[ix]
        rep = np.repeat(np.arange(len(at)), many)
        ref = block.first[ix][rep] + np.arange(len(rep)) - (np.cumsum(many) - many)[rep]
        hits_item.append(block.item[ref])
        hits_pos.append(block.pos[ref])
        hits_diag.append(at[rep] - block.pos[ref])
    return (np.concatenate(hits_item), np.concatenate(hits_pos), np.concatenate(hits_diag)) if hits_item else None


def search(texts: list[str], block: Block, regions: bool = True) -> list[list]:
    """For every text the (item index, edits, end) of the whole items within
    their edit budgets, the best occurrence of each; with ``regions`` also the
    best window (the first of equal ones) of each other item."""
    found: list[list] = [[] for _ in texts]
    some: list[int] = []
    codes, chars = [], 0
    for j, text in enumerate(texts):
        if text:
            some.append(j)
            codes.append(codes_of(text))
            chars += len(codes[-1])
        if len(some) >= TOGETHER or chars >= TOGETHER_CHARS or (some and j == len(texts) - 1):
            for k, rows in zip(some, _together(codes, block, regions)):
                found[k] = rows
            some, codes, chars = [], [], 0
    if some:
        for k, rows in zip(some, _together(codes, block, regions)):
            found[k] = rows
    return found


def _together(codes: list[np.ndarray], block: Block, regions: bool) -> list[list]:
    hits = [_hits(c, block) for c in codes]
    whole = _verified(codes, block, [(t, *x) for t, h in enumerate(hits) if h for x in _whole(block, h)], by_end=True)
    out = [dict(_short(c, block)) for c in codes]
    for (t, i), got in whole.items():
        out[t][i] = got
    if regions:
        parts = [(t, *x) for t, h in enumerate(hits) if h for x in _windows(block, h) if (t, x[0]) not in whole]
        for (t, i), got in _verified(codes, block, parts, by_end=False).items():
            out[t][i] = got
    return [sorted((i, *got) for i, got in rows.items()) for rows in out]


def _verified(codes: list[np.ndarray], block: Block, parts: list[tuple], by_end: bool) -> dict:
    """{(text, item): (edits, end)} of the best of the candidates (text, item,
    start and length of the item's part, edits allowed, diagonals from, to); of
    equal edits the one that ends first, or else the first in order."""
    if not parts:
        return {}
    text, item, a, m, k, low, high = np.array(parts, np.int64).T
    edits, end = align([block.codes[i][x:x + y] for i, x, y in zip(item.tolist(), a.tolist(), m.tolist())],
                       [codes[t] for t in text.tolist()], low, high, k)
    best: dict = {}
    for j in np.flatnonzero(edits >= 0).tolist():
        key, got = (int(text[j]), int(item[j])), (int(edits[j]), int(end[j]))
        if key not in best or (got < best[key] if by_end else got[0] < best[key][0]):
            best[key] = got
    return best


def _short(c: np.ndarray, block: Block) -> list:
    """Items too short for a q-gram that occur as whole words: edits 0 and the
    end of the first occurrence."""
    found: dict = {}
    for length, known in block.short.items():
        grams = _grams(c, length)
        for at in np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64))).tolist():
            before, after = c[at - 1:at], c[at + length:at + length + 1]
            if any(chr(x).isalnum() for x in (*before.tolist(), *after.tolist())):
                continue
            for i in known[int(grams[at])]:
                if i not in found and np.array_equal(block.codes[i], c[at:at + length]):
                    found[i] = (0, at + length)
    return list(found.items())


def find(text: str, block: Block) -> list:
    """(item index, edits, end) of every whole item within its edit budget in
    the text, the best occurrence of each."""
    return search([text], block, regions=False)[0]


def find_regions(text: str, block: Block) -> list:
    """As ``find``, and of the other items the best window (the first of equal
    ones) within its edit budget."""
    return search([text], block)[0]


def _windows(block: Block, hits: tuple) -> list:
    """(item, start, length, edits, diagonals from, to) of the windows to align."""
    item, pos, diag = hits
    q, size, window, edits = block.q, block.size, block.window, block.window_edits
    need = window + 1 - q * (edits + 1)
    keep = ((np.bincount(item, minlength=len(size)) >= need) & (size > window))[item]
    if not keep.any():
        return []
    item, pos, diag = item[keep], pos[keep], diag[keep]
    width = np.maximum(16, 2 * edits)
    band, rest = np.divmod(diag, width[item])
    low = rest < edits[item]  # each band overlaps the next by the edits
    item, pos, band = (np.concatenate([x, y]) for x, y in ((item, item[low]), (pos, pos[low]), (band, band[low] - 1)))
    # hits whose item and band hold enough for any window
    span = int(band.max() - band.min()) + 1
    slot = (item * span + (band - band.min())) & 0x3FFF  # sharing a slot only keeps more
    keep = np.bincount(slot)[slot] >= need[item]
    if not keep.any():
        return []
    item, pos, band = item[keep], pos[keep], band[keep]
    # windows 0 .. last-1 start every step, window last ends with the item; a q-gram lies in at most three
    long, step = window[item], window[item] // 2
    last = -(-(size[item] - long) // step)
    parts = []
    for w in (pos // step, pos // step - 1, last):
        start = np.minimum(w * step, size[item] - long)
        ok = (w >= 0) & (w <= last) & (start <= pos) & (pos + q <= start + long)
        if w is not last:
            ok &= w < last
        parts.append((item[ok], start[ok], band[ok]))
    keys, counts = np.unique(np.stack([np.concatenate(x) for x in zip(*parts)]), axis=1, return_counts=True)
    i, a, b = keys[:, counts >= need[keys[0]]]
    low = b * width[i] + a
    return np.stack([i, a, window[i], edits[i], low, low + width[i] + edits[i]], 1).tolist()


def _whole(block: Block, hits: tuple) -> list:
    """(item, 0, length, edits, diagonals from, to) of the bands to align."""
    item, _, diag = hits
    m, k = block.size, block.edits
    need = m + 1 - block.q * (k + 1)
    keep = (np.bincount(item, minlength=len(m)) >= need)[item]
    if not keep.any():
        return []
    item, diag = item[keep], diag[keep]
    width = np.maximum(16, 2 * k)
    band, rest = np.divmod(diag, width[item])
    low = rest < k[item]  # each band overlaps the next by the edits
    keys, counts = np.unique(np.stack([np.concatenate([item, item[low]]), np.concatenate([band, band[low] - 1])]), axis=1, return_counts=True)
    i, b = keys[:, counts >= need[keys[0]]]
    return np.stack([i, i * 0, m[i], k[i], b * width[i], b * width[i] + width[i] + k[i]], 1).tolist()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list]:
    """The benchmark in blocks of at most ``block_chars`` characters (or of one
    item): shares of a hash, more of them until each fits.  A block is read
    only when it is asked for."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size, longest = rows.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    most, n = max(block_chars, longest or 0), max(1, -(-(size or 0) // block_chars))
    while n > 1:
        share = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        full = rows.groupBy(share.alias("s")).agg(F.sum(F.length("text")).alias("c"), F.countDistinct("item", "text").alias("d"))
        if full.filter((F.col("c") > most) & (F.col("d") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int, apply) -> Iterator[DataFrame]:
    """``apply(shared block)`` for every block.  Of several, each one's rows
    are written before the next block is read, so that the driver and the
    executors hold one at a time."""
    context, waiting = benchmark.sparkSession.sparkContext, None
    for items in _blocks(benchmark, item_col, text_col, block_chars):
        if waiting is not None:
            yield materialise(apply(waiting), "benchmark-block")
            waiting.destroy()
        waiting = context.broadcast(items)
    yield apply(waiting)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = EDIT_RATE,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, edits, end) for every row and item whose text, or a window
    of ``REGION`` characters of it, occurs in the row's within the edit budget
    (``rate`` of the characters), after lower-casing and collapsing white space;
    edits and end are the whole item's, else those of its best window.

    Items are a stated query set: a block of bounded size goes to the tasks,
    larger benchmarks take further passes.  Items of fewer than ``q``
    characters match exactly, as whole words, those of fewer than ``SHORT_MIN``
    not at all; null texts match nothing; repeated rows each give their
    matches; empty tables give no rows; other columns are never read.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {benchmark.schema[item_col].dataType.simpleString()}, edits int, `end` long"

    def found(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            block = build_block(shared.value, q, rate)
            for b in batches:
                rows = [(doc, block.ids[i], edits, end) for doc, got in zip(b["rid"], search(b["text"].tolist(), block)) for i, edits, end in got]
                yield pd.DataFrame(rows, columns=[id_col, item_col, "edits", "end"], dtype=object)
        return docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text")).mapInPandas(run, schema)

    out = None
    for part in _passes(benchmark, item_col, item_text, block_chars, found):
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", q: int = Q,
                 rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> Iterator:
    """Arrow-batched column functions, one a block, made as they are asked for:
    text -> whether an item or a window of one occurs in it (null: no)."""
    def tester(shared):
        def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            block = build_block(shared.value, q, rate)
            for texts in batches:
                yield pd.Series([bool(got) for got in search(texts.tolist(), block)], dtype=bool)
        return F.pandas_udf(test, "boolean").asNondeterministic()

    context = benchmark.sparkSession.sparkContext
    for items in _blocks(benchmark, item_col, item_text, block_chars):
        yield tester(context.broadcast(items))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows (all columns) whose text holds no item and no window of one.
    What a block leaves is written before the next block is read."""
    tests = 0
    for test in contaminated(benchmark, **options):
        docs = docs if not tests else materialise(docs, "benchmark-clean")
        docs = (docs.select(F.struct("*").alias("__row"), test(F.col(text_col)).alias("__bad"))
                .filter(~F.col("__bad")).select("__row.*"))
        tests += 1
    return docs
