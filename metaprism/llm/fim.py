"""Fill-in-the-middle transformation by displacement scatter.

The texts of an Arrow batch are one run of bytes.  A scan finds the cuts
between tokens; three segments a document (prefix, middle, suffix) each move
by one displacement, whose differences are written at the segments' first
bytes.  Their cumulative sum is every byte's displacement, one numpy scatter
builds all outputs, and the inverse gather (displacements found from the
markers of an output alone) restores the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of the output, by the letter between the brackets.
LETTERS = np.frombuffer(b"PSM", np.uint8)
#: Per cent of the documents that are cut, and of these in suffix-first order.
CUT_RATE, SPM_RATE, SEED = 50, 80, 42
#: Bytes that are moved at once; a longer document is moved on its own.
STEP = 1 << 21
FORMS = ("plain", "psm", "spm")
_MARK = 3
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[LETTERS] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the len + 1 offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def strings_of(raw: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``bytes_of``; rows that are not ``valid`` are null."""
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)), mask)
    return out.cast(pa.string())


def slices(off: np.ndarray, step: int):
    """Runs of documents of at most ``step`` bytes, or of one document."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + step, "right")) - 1)
        yield a, b
        a = b


def marks_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, document) of every marker that lies inside one document."""
    if len(raw) < _MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")) & _IS_LETTER[raw[1:-1]])
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + _MARK <= off[doc + 1]
    return at[inside], doc[inside]


def displaced(starts: np.ndarray, shifts: np.ndarray, total: int) -> np.ndarray:
    """Where each of ``total`` positions goes: segment j, from ``starts[j]`` on
    (in ascending order, empty ones included), moves by ``shifts[j]``."""
    diff = np.zeros(total + 1, np.int64)
    np.add.at(diff, starts, np.diff(shifts, prepend=0))
    return np.arange(total) + np.cumsum(diff[:total])


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def scatter(raw: np.ndarray, off: np.ndarray, draws: np.ndarray, cut_rate: int, spm_rate: int):
    """Outputs of some documents: (bytes, offsets, tokens, form number, prefix
    and middle in code points).  ``draws`` holds four numbers a document."""
    start, end, docs = off[:-1], off[1:], len(off) - 1
    space = _SPACE[raw]
    stop = np.append(space[1:], True) if len(raw) else space
    stop[end[end > start] - 1] = True
    ends = np.flatnonzero(~space & stop) + 1  # after each word
    first = np.searchsorted(ends, start, "right")
    words = np.searchsorted(ends, end, "right") - first
    n = words + ((end > start) & np.append(space, False)[end - 1])  # white space at the end is a token

    def cut(k):
        inner = (k > 0) & (k <= words)
        at = np.where(k == 0, start, end)
        at[inner] = ends[(first + k - 1)[inner]]
        return at

    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    a, b = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    marked = np.zeros(docs, bool)
    marked[marks_of(raw, off)[1]] = True
    plain = (end == start) | marked | (draws[:, 2] % 100 >= cut_rate)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < spm_rate, 2, 1))

    out_off = _offsets(end - start + np.where(plain, 0, 3 * _MARK))
    out = out_off[:-1]
    prefix, suffix = a - start, end - b
    p = np.where(plain, out, np.where(form == 1, out + _MARK, out + 2 * _MARK + suffix))
    s = np.where(plain, out + (b - start), np.where(form == 1, out + 2 * _MARK + prefix, out + _MARK))
    m = np.where(plain, out + prefix, out + 3 * _MARK + prefix + suffix)
    to = displaced(np.stack([start, a, b], 1).ravel(), np.stack([p - start, m - a, s - b], 1).ravel(), len(raw))
    moved = np.empty(out_off[-1], np.uint8)
    moved[to] = raw
    for letter, at in zip(LETTERS, (p, s, m)):  # each marker stands before its segment
        at = at[~plain]
        moved[at - 3], moved[at - 2], moved[at - 1] = ord("<"), letter, ord(">")

    chars = _offsets((raw & 0xC0) != 0x80)
    return moved, out_off, n, form, chars[a] - chars[start], chars[b] - chars[a]


def gather(raw: np.ndarray, off: np.ndarray, form: np.ndarray):
    """Texts of some outputs: (bytes, offsets, valid).  An output whose form
    asks for markers and which has not each of them once, in its form's order,
    the first at its start, is not valid and gives nothing."""
    at, doc = marks_of(raw, off)
    cut = form > 0
    at, doc = at[cut[doc]], doc[cut[doc]]
    three = np.bincount(doc, minlength=len(form)) == 3
    keep = three[doc]
    at, doc = at[keep].reshape(-1, 3), doc[keep].reshape(-1, 3)[:, 0]
    order = np.array([[0, 0, 0], [0, 1, 2], [1, 0, 2]])[form[doc]]
    right = (raw[at + 1] == LETTERS[order]).all(1) & (at[:, 0] == off[doc])
    at, doc = at[right], doc[right]
    valid = ~cut
    valid[doc] = True

    start, end = off[:-1], off[1:]
    size = np.where(valid, end - start - np.where(cut, 3 * _MARK, 0), 0)
    text_off = _offsets(size)
    to = text_off[:-1]
    seg = np.stack([start, start, start], 1)  # where prefix, middle and suffix lie in the output
    part = np.stack([size, size * 0, size * 0], 1)
    one, two, three = at[:, 0] + _MARK, at[:, 1] + _MARK, at[:, 2] + _MARK
    len1, len2, len3 = at[:, 1] - one, at[:, 2] - two, end[doc] - three
    psm = form[doc] == 1
    seg[doc] = np.stack([np.where(psm, one, two), three, np.where(psm, two, one)], 1)
    part[doc] = np.stack([np.where(psm, len1, len2), len3, np.where(psm, len2, len1)], 1)
    starts = np.stack([to, to + part[:, 0], to + part[:, 0] + part[:, 1]], 1)
    return raw[displaced(starts.ravel(), (seg - starts).ravel(), int(text_off[-1]))], text_off, valid


RESULT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def transformer(cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE, step: int = STEP):
    """Column function (text, four draws as an array) -> ``RESULT``."""
    def run(texts: pa.Array, draws: pa.Array) -> pa.Array:
        raw, off = bytes_of(texts)
        numbers = draws.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        parts = []
        for a, b in slices(off, step):
            moved, out_off, n, form, prefix, middle = scatter(raw[off[a]:off[b]], off[a:b + 1] - off[a], numbers[a:b], cut_rate, spm_rate)
            plain = form == 0
            parts.append(pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(FORMS).take(pa.array(form)),
                 pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), strings_of(moved, out_off)],
                names=["n", "form", "prefix_chars", "middle_chars", "output"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
            [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]))
    return F.arrow_udf(run, RESULT)


def restorer(step: int = STEP):
    """Column function (output, form) -> text."""
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        raw, off = bytes_of(outputs)
        form = pc.fill_null(pc.index_in(forms, pa.array(FORMS)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for a, b in slices(off, step):
            got = gather(raw[off[a]:off[b]], off[a:b + 1] - off[a], form[a:b])
            parts.append(strings_of(*got))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return F.arrow_udf(run, "string")


def draws_of(key: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers: the first digits of the SHA-256 of the
    seed, a colon and the key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*[F.lit(1 + 8 * i) for i in range(4)]),
                       lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per row.

    A token is a word with the white space before it, or white space at the
    end.  A null text is an empty one; empty texts and texts that hold a marker
    stay plain; rows that share an id share their draws; a null id draws as the
    empty string; other columns are never read; no rows give no rows.  Map-only.
    """
    made = transformer(cut_rate, spm_rate)(F.col("text"), F.col("draws"))
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), draws_of(F.col(id_col), seed).alias("draws"))
            .select("id", made.alias("made")).select(F.col("id").alias(id_col), "made.*"))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "text") -> DataFrame:
    """``rows`` with the text that each output was made of, from the output
    and its form alone; null where the markers do not fit the form."""
    return rows.withColumn(out, restorer()(F.col(output_col), F.col(form_col)))


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``transform`` with digests of the output and of the text
    that is restored from it."""
    return restore(rows, out="__text").select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("__text"), 256).alias("restored_sha256"))
