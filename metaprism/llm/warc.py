"""WARC archives: writing segmented records, reading archives, reassembly.

A writer stores each page as a record, cut into continuation records where its
block is longer than a segment; payloads travel in chunked transfer framing.
Reassembly groups continuation records by origin identifier, orders them by
segment number, verifies the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote
from typing import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_path

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records a file holds at most; with whole segments that bounds its size.
FILE_RECORDS = 4_000
_EOL = b"\r\n"
_DATE = b"2024-01-01T00:00:00Z"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- framing -----------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for a in range(0, len(payload), size):
        piece = payload[a:a + size]
        out += [b"%X" % len(piece), _EOL, piece, _EOL]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> tuple[bytes, bool]:
    """(payload, whole): decoded as far as the framing is sound.  Chunk
    extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(_EOL, at)
        if end < 0:
            return b"".join(out), False
        head = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", head):
            return b"".join(out), False
        n, at = int(head, 16), end + 2
        if n == 0:
            return b"".join(out), True
        out.append(body[at:at + n])
        if body[at + n:at + n + 2] != _EOL:
            return b"".join(out), False
        at += n + 2


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(k + b": " + v + _EOL for k, v in fields) + _EOL


def _id_part(page_id: str | None) -> bytes:
    """An id as part of a record's name, percent-encoded; ~ is the null id."""
    return b"~" if page_id is None else quote(page_id, safe="").replace("~", "%7E").encode()


def _one_line(value: str) -> bytes:
    return re.sub(r"[\r\n]+", " ", value).encode("utf-8", "replace")


def records_of(page_id: str | None, unique: str, url: str | None, payload: bytes, sha1: str, refers_to: str | None,
               segment_bytes: int, chunk_bytes: int) -> list:
    """The WARC records of one page: a revisit, or a response and its
    continuations (bytes without the last line end)."""
    digest = base64.b32encode(bytes.fromhex(sha1))
    name = b"<urn:page:%s:%s#%s>" % (_id_part(page_id), digest, unique.encode())
    uri = [(b"WARC-Target-URI", _one_line(url))] if url else []
    common = [(b"WARC-Date", _DATE), *uri, (b"Content-Type", b"application/http;msgtype=response"),
              (b"WARC-Payload-Digest", b"sha1:" + digest)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_head([(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name), *common, (b"WARC-Profile", _PROFILE),
                       (b"WARC-Refers-To", b"<urn:page:%s:%s>" % (_id_part(refers_to), digest)),
                       (b"Content-Length", b"%d" % len(block))]) + block + _EOL]
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + chunked(payload, chunk_bytes))
    pieces = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    out = []
    for k, piece in enumerate(pieces, 1):
        part = [] if len(pieces) == 1 else [(b"WARC-Segment-Number", b"%d" % k)]
        if k == 1:
            fields = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", name), *common]
        else:
            fields = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", name[:-1] + b".%d>" % k),
                      (b"WARC-Date", _DATE), (b"WARC-Segment-Origin-ID", name)]
            if k == len(pieces):
                part.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_head([*fields, *part, (b"Content-Length", b"%d" % len(piece))]) + piece + _EOL)
    return out


# --- writing -----------------------------------------------------------------

def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds sha1 and refers_to (the smallest id with an equal payload of at
    least ``min_bytes``; null for the response itself) to (rid, url, html).

    Digests collapse before the shuffle, and what comes back is joined by id,
    so a payload that a third of the pages share meets nobody in one task.
    """
    keyed = pages.withColumn("sha1", F.sha1(F.col("payload")))
    small = materialise(keyed.select("rid", "sha1", F.length("payload").alias("bytes")), "warc-digests")
    first = small.filter(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min("rid").alias("refers_to"), F.count("*").alias("n"))
    shared = materialise(first.filter("n > 1 and refers_to is not null"), "warc-shared")
    repeats = small.filter((F.col("bytes") >= min_bytes) & F.col("rid").isNotNull())
    back = (lookup(repeats, shared, "sha1", "n").filter("rid <> refers_to")
            .select(F.col("rid").alias("r"), F.col("sha1").alias("s"), F.col("refers_to").cast("string").alias("refers_to")).distinct())
    known = keyed.filter("rid is not null").join(back, (F.col("rid") == F.col("r")) & (F.col("sha1") == F.col("s")), "left").drop("r", "s")
    # rows without an id have nothing but their digest to be joined by: its frequent values are broadcast
    none = lookup(keyed.filter("rid is null"), shared, "sha1", "n", how="left").withColumn(
        "refers_to", F.when(F.length("payload") >= min_bytes, F.col("refers_to")).cast("string"))
    return known.unionByName(none)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   file_records: int = FILE_RECORDS) -> None:
    """Gzipped WARC files below ``path``, one record a row (and its
    continuations)."""
    rows = pages.select(F.col(id_col).alias("rid"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for rid, url, payload, sha1, ref in zip(b["rid"], b["url"], b["payload"], b["sha1"], b["refers_to"]):
                n += 1
                out += records_of(rid, f"{task}.{n}", url, bytes(payload), sha1, ref,
                                  segment_bytes, chunk_bytes)
            yield pd.DataFrame({"record": out})

    marked = revisits(rows, min_bytes).withColumn("rid", F.col("rid").cast("string"))
    # a line end closes each record; the cast keeps the bytes as they are
    (marked.select("rid", "url", "payload", "sha1", "refers_to").mapInPandas(emit, "record binary")
     .select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", file_records).text(path))


# --- reading -----------------------------------------------------------------

RECORD = ("record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, "
          "origin_id string, segment int, total_length long, whole boolean, block binary")


def _inflate(data: bytes) -> bytes:
    """Plain or gzipped (one or many members) archive bytes, as far as sound."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple]:
    """RECORD rows of an archive; garbage between records is skipped, a block
    cut off by the end of the file is not ``whole``."""
    at = data.find(b"WARC/")
    while at >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        fields = {}
        for line in data[at:head_end].split(_EOL)[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() else None
        n = number(b"content-length") or 0
        block = data[head_end + 4:head_end + 4 + n]
        yield (fields.get(b"warc-record-id"), fields.get(b"warc-type"), fields.get(b"warc-target-uri"),
               fields.get(b"warc-refers-to"), fields.get(b"warc-payload-digest"),
               fields.get(b"warc-segment-origin-id"), number(b"warc-segment-number"),
               number(b"warc-segment-total-length"), len(block) == n, block)
        at = data.find(b"WARC/", head_end + 4 + n)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of every archive below ``path``; a file is read by one task
    and unpacked there, so files should be of bounded size."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(parse(_inflate(bytes(content)))), columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(unpack, RECORD)


# --- reassembly --------------------------------------------------------------

DECODED = "status string, payload binary, payload_bytes long, payload_digest string"


def decode(block: bytes | None, warc_type: str | None, declared: str | None) -> tuple:
    """(status, payload, bytes, digest) of a whole block: HTTP head off,
    chunked framing decoded, payload checked against the declared digest.  A
    revisit has no payload here: length and digest are those it declares."""
    head, gap, body = (block or b"").partition(b"\r\n\r\n")
    lower = head.lower()
    said = declared.split(":", 1)[-1] if declared else None
    if warc_type == "revisit":
        m = re.search(rb"\r\ncontent-length:\s*([0-9]+)", lower)
        return "ok", None, int(m[1]) if m else None, said
    sound = bool(gap)
    if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", lower):
        body, sound = unchunk(body)
    got = digest32(body)
    status = "bad_framing" if not sound else "digest_mismatch" if said and said != got else "ok"
    return status, body, len(body), got


def reassemble(records: DataFrame) -> DataFrame:
    """One row per record: record_id, warc_type, target_uri, refers_to,
    segments, DECODED.

    Continuations join the record whose id they name as origin, in order of
    segment number.  Status is ``missing_segment`` where numbers 1..n, the
    first record or the last one's total length are missing, ``length_mismatch``
    where the total differs, ``truncated`` where a block was cut off,
    ``bad_framing`` or ``digest_mismatch`` from decoding, else ``ok``.  A
    segment that occurs again in other archives counts once (the smallest of
    differing copies).  Records without segment numbers never shuffle.  A
    continuation without origin stands alone with status ``missing_segment``.
    """
    single = records.filter("segment is null and warc_type is distinct from 'continuation'").select(
        "record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "block", F.lit(1).alias("segments"),
        F.when(F.col("whole"), "ok").otherwise("truncated").alias("state"))
    parts = (records.filter("segment is not null or warc_type = 'continuation'")
             .withColumn("origin", F.coalesce("origin_id", "record_id"))
             .withColumn("head", F.when(F.col("warc_type") != "continuation", F.struct("warc_type", "target_uri", "refers_to", "payload_digest")))
             .groupBy("origin", "segment")  # repeated segments collapse before the shuffle
             .agg(F.min(F.struct("block", "whole")).alias("b"), F.max("head").alias("head"), F.max("total_length").alias("total_length"))
             .groupBy("origin")
             .agg(F.array_sort(F.collect_list(F.struct("segment", "b.block", "b.whole"))).alias("s"),
                  F.max("head").alias("head"), F.max("total_length").alias("total")))
    block = F.array_join(F.transform("s", lambda x: x["block"].cast("string")), "").cast("binary")
    numbered = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))
    joined = parts.select("origin", "s", "head", "total", block.alias("block")).select(
        F.col("origin").alias("record_id"), F.coalesce("head.warc_type", F.lit("continuation")).alias("warc_type"),
        "head.target_uri", "head.refers_to", "head.payload_digest", "block", F.size("s").alias("segments"),
        F.when(F.exists("s", lambda x: ~x["whole"]), "truncated")
        .when(F.col("head").isNull() | F.col("total").isNull() | ~F.coalesce(numbered, F.lit(False)), "missing_segment")
        .when(F.length("block") != F.col("total"), "length_mismatch").otherwise("ok").alias("state"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blocks, types, declared in batches:
            yield pd.DataFrame([decode(None if b is None else bytes(b), t, d) for b, t, d in zip(blocks, types, declared)],
                               columns=["status", "payload", "payload_bytes", "payload_digest"], dtype=object)

    unframe = F.pandas_udf(run, DECODED).asNondeterministic()
    return (single.unionByName(joined)
            .withColumn("d", unframe("block", "warc_type", "payload_digest"))
            .select("record_id", "warc_type", "target_uri", "refers_to", "segments",
                    F.when(F.col("state") != "ok", F.col("state")).otherwise(F.col("d.status")).alias("status"),
                    "d.payload", "d.payload_bytes", "d.payload_digest"))


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages, read the archives back and reassemble; adds the id.

    Null html is an empty payload; a null url has no target; rows that share
    the smallest id of a payload are all responses; a null id never answers
    for another page; an empty table gives no rows; other columns are never
    read."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType.simpleString()

    def id_of(name):
        part = F.regexp_extract(name, r"^<urn:page:([^:]*):[A-Z2-7]{32}", 1)
        return F.when(part != "~", F.url_decode(part)).cast(kind)

    return (reassemble(read_records(spark, path))
            .withColumn(id_col, id_of(F.col("record_id")))
            .withColumn("refers_to_id", F.when(F.col("warc_type") == "revisit", id_of(F.col("refers_to")))))
