"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks that overlap.  Every chunk is pre-tokenised on
its own, wherever its task runs; a chunk's first boundaries may be wrong, as it
can begin inside a pre-token.  The pattern looks at nothing before its match,
so from the first boundary on which two neighbours agree inside their overlap
both go on alike: there the chunks are stitched.  Where neighbours never agree
(one pre-token covers the whole overlap) the rest of that text is one piece.
The pieces between stitches are then encoded; decoding concatenates the raw
bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Characters of a chunk's own part, and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 14, 1 << 9
#: A match that ends this near to a chunk's end could go on behind it.
MARGIN = 4
#: Texts that are encoded before their ids leave the task.
ROWS = 256
#: Rank files beyond this are refused: the file goes to every task.
MAX_RANK_BYTES = 1 << 26


class Vocabulary:
    """A rank file and the pattern that splits texts before the merges; travels
    to the tasks as raw bytes and is built there once a worker."""

    _built: dict = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.raw = f.read(MAX_RANK_BYTES + 1)
        if len(self.raw) > MAX_RANK_BYTES:
            raise ValueError(f"{path} exceeds {MAX_RANK_BYTES} bytes")
        self.pattern = pattern

    def _parts(self):
        key = (hash(self.raw), self.pattern)
        if key not in self._built:
            import regex
            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            merges = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            known = [b""] * (max(ranks.values(), default=-1) + 1)
            for b, i in ranks.items():
                known[i] = b
            self._built[key] = merges.encode_ordinary, regex.compile(self.pattern), known
        return self._built[key]

    def encode(self, texts: list[str]) -> pa.Array:
        rows = [np.array(self._parts()[0](t), np.int32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    @property
    def split(self):
        return self._parts()[1]

    @property
    def bytes(self) -> list:
        return self._parts()[2]


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(number, text) of the overlapping chunks; the last one's own part may be
    longer by the overlap, all others are followed by a whole overlap."""
    for i in range(max(1, -(-(len(text) - overlap) // chunk))):
        yield i, text[i * chunk:(i + 1) * chunk + overlap]


def boundaries(text: str, i: int, last: bool, vocab: Vocabulary, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts of the chunk's pre-tokens, as places in the whole text: those in
    what it shares with the chunk before, and those in what it shares with the
    next (there only such as more text behind the chunk could not change)."""
    base, head, tail = i * chunk, [], []
    for m in vocab.split.finditer(text):
        at = m.start()
        if at < overlap and i:
            head.append(base + at)
        if at >= chunk and not last:
            if at > len(text) - MARGIN:
                break
            tail.append(base + at)
    return head, tail


_CHUNK = "rid long, i int, last boolean, text string"


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(id, rid, i, last, text): the chunks of all texts, written to the shared
    folder, since what follows reads them twice."""
    id_type = long.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):  # a batch a text: bounded by the longest one
                parts = list(cut(batch["text"][j].as_py(), chunk, overlap))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(pa.array([j] * n)), pa.array([batch["rid"][j].as_py()] * n, pa.int64()),
                     pa.array([i for i, _ in parts], pa.int32()), pa.array([i == n - 1 for i, _ in parts]),
                     pa.array([t for _, t in parts], pa.string())], names=["id", "rid", "i", "last", "text"])

    cutted = long.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, f"id {id_type}, {_CHUNK}")
    return materialise(cutted.repartition(F.xxhash64("rid", "i")), "bpe-chunks")


def _stitches(chunks: DataFrame, vocab: Vocabulary, chunk: int, overlap: int) -> DataFrame:
    """(rid, i, at, after, piece, alone): the piece that chunk ``i`` belongs
    to, whether it is the only one there, and where the piece begins (null but
    in its first chunk) and ends (null for the end of the text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = pa.list_(pa.int64())
        for batch in batches:
            found = [boundaries(t.as_py(), i, last, vocab, chunk, overlap) for t, i, last in
                     zip(batch["text"], batch["i"].to_pylist(), batch["last"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["i"], pa.array([h for h, _ in found], places),
                                              pa.array([t for _, t in found], places)], names=["rid", "i", "head", "tail"])

    sides = materialise(chunks.select("rid", "i", "last", "text").mapInArrow(run, "rid long, i int, head array<long>, tail array<long>"), "bpe-sides")
    before = sides.select("rid", (F.col("i") + 1).alias("i"), "tail")
    at = F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", "tail")))
    joined = sides.drop("tail").join(before, ["rid", "i"], "left").select("rid", "i", at.alias("at"))
    text = Window.partitionBy("rid").orderBy("i")  # a few numbers a chunk of one text
    lost = joined.withColumn("lost", F.max(F.col("at").isNull()).over(text))  # what follows was not compared with anything sure
    sure = lost.withColumn("at", F.when(~F.col("lost"), F.col("at")))
    return sure.select("rid", "i", "at", F.lead("at").over(text).alias("after"), F.count("at").over(text).alias("piece"),
                       (~F.col("lost") & ~F.coalesce(F.lead("lost").over(text), F.lit(False))).alias("alone"))


def _whole_piece(key, table: pa.Table, vocab: Vocabulary, chunk: int) -> pa.Table:
    """Ids of the chunks between two stitches."""
    table = table.sort_by("i")
    base, texts = table["i"][0].as_py() * chunk, table["text"].to_pylist()
    text = "".join([t[:chunk] for t in texts[:-1]] + texts[-1:])
    at, after = table["at"][0].as_py(), table["after"][-1].as_py()
    ids = vocab.encode([text[at - base:None if after is None else after - base]])
    return table.slice(0, 1).select(["id", "rid", "i"]).append_column("ids", ids)


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>), one row per row: the ids of the whole text.

    A text of at most ``chunk`` characters is one piece and encoded where it
    is read; the chunks of longer ones are dealt to all tasks.  A null text is
    an empty one and has no ids; repeated rows each give a row; a null id is
    kept; other columns are never read; no rows give no rows.  A pre-token is
    never cut: a text that holds one longer than ``overlap`` across a chunk's
    end is encoded in one task from there on.
    """
    if not MARGIN < overlap <= chunk:
        raise ValueError("the overlap must be longer than the margin and not exceed the chunk")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([part["id"], vocab.encode(part["text"].to_pylist())], names=["id", "ids"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py()[at - i * chunk:None if after is None else after - i * chunk] for t, i, at, after in
                     zip(batch["text"], *(batch[c].to_pylist() for c in ("i", "at", "after")))]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["rid"], batch["i"], vocab.encode(texts)], names=["id", "rid", "i", "ids"])

    chunks = _chunks(rows.filter(is_long), chunk, overlap)
    joined = chunks.join(materialise(_stitches(chunks, vocab, chunk, overlap), "bpe-stitches"), ["rid", "i"]).select(
        "id", "rid", "i", "text", "at", "after", "piece", "alone")
    encoded = f"id {id_type}, rid long, i int, ids array<int>"
    pieces = joined.filter("alone").mapInArrow(one, encoded).unionByName(
        joined.filter("not alone").groupBy("rid", "piece").applyInArrow(
            lambda key, table: _whole_piece(key, table, vocab, chunk), encoded))
    whole = pieces.groupBy("rid").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p"))
    return (rows.filter(~is_long).mapInArrow(short, f"id {id_type}, ids array<int>")
            .unionByName(whole.select("id", F.flatten("p.ids").alias("ids")))
            .withColumnRenamed("id", id_col))


def decoder(vocab: Vocabulary):
    """Column function ids -> raw bytes (null: null; an unknown id raises)."""
    def run(ids: pa.Array) -> pa.Array:
        known = vocab.bytes
        offsets, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
        return pa.array([b"".join(map(known.__getitem__, flat[a:b].tolist())) if some else None for a, b, some in
                         zip(offsets, offsets[1:], ids.is_valid().to_pylist())], pa.binary())
    return F.arrow_udf(run, "binary")


def digest(rows: DataFrame, vocab: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """Lengths and digests of the ids and of the bytes decoded from them."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2(decoder(vocab)(F.col("ids")), 256).alias("decoded_sha256"))
