"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, so a lost
    executor never replays what came before, and later readers share one copy."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda variable), however
    often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner",
           hot: int = 512) -> DataFrame:
    """Join skewed ``rows`` with ``table`` (one row per key; ``how`` inner or left).

    ``weight`` is the number of ``rows`` a key has.  Fewer than ``hot`` keys
    can hold more than 1/hot of all rows, so the heavy keys form a broadcast
    table of proven size and never meet in one task; the other keys hold at
    most that share each and join by shuffle.  ``rows`` is read twice.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > F.lit(total / hot)
    top = F.broadcast(table.filter(heavy).drop(weight))
    rest = table.filter(~heavy).drop(weight)
    return (rows.join(top, key, "inner")
            .unionByName(rows.join(top.select(key), key, "left_anti").join(rest, key, how)))


SPAN = "struct<start:int,ord:int,end:int,kind:string,match:string>"
SPANS = f"array<{SPAN}>"
_BLOCK = 128


def no_spans() -> Column:
    return F.array().cast(SPANS)


def regex_spans(text: Column, pattern: str, kind: str, order: int, ok=None) -> Column:
    """Spans (start, ord, end, kind, match) of a pattern's leftmost
    non-overlapping matches, in code points; ``ok(match)`` drops failing ones.

    The pieces between the matches (``split``) and the matches themselves give
    every position as a running sum, in blocks so that many matches in one
    text stay cheap.  The pattern must not match empty text.
    """
    def run(start, pairs):
        return F.aggregate(
            pairs, F.struct(start.alias("at"), no_spans().alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + F.length(x["g"])).alias("start"), F.lit(order).alias("ord"),
                    (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                    F.lit(kind).alias("kind"), x["m"].alias("match")).cast(SPAN))).alias("out")))

    def blocks(pairs):
        n = F.ceil(F.size(pairs) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))

    def joined(chunks):
        return F.flatten(F.aggregate(
            chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")),
            lambda acc, c: let(run(acc["at"], c), lambda r: F.struct(
                r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(found, lambda ms: F.when(F.size(ms) == 0, no_spans()).otherwise(
        let(F.zip_with(ms, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms)),
                       lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
            lambda pairs: joined(blocks(pairs)))))
    return spans if ok is None else F.filter(spans, lambda s: ok(s["match"]))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed (the structs' own order)."""
    return F.array_sort(spans)


def span_string(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, of spans ordered already."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
