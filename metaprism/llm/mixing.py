"""Mixing sources to target weights by weighted fair queueing (DataFrame
operations only).

Every document of a source, in shuffled order, gets a virtual finish time:
the words its source has sent up to and including it, divided by the source's
target.  Later passes over the source continue the running sum.  All copies
are range-sorted by finish time and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranking import rank_within
from .common import WORD, materialise

#: Leading hex digits of the shuffle hash that cut a source's order into ranges.
PART_DIGITS = 3
#: Ranges that the finish times are cut into.
RANGES = 1024
#: Copies that a final range may hold before it is cut again.
FINAL_ROWS = 20_000


def _source_key(c: Column) -> Column:
    """Code-point order with null last, as one non-null string."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def fair_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(skey, source_size, target) from one row (skey, source_size) a source.

    ``share`` of all sizes goes to the sources by weight; a target stops at
    ``most`` times its source and the excess is shared again by weight.  Each
    round is one aggregate; a round only ever adds capped sources.
    """
    order = Window.orderBy("skey")  # one row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = materialise(sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))), "mix-sources")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(rate) > F.col("cap")
        n, fixed, free = rows.agg(
            F.sum(over.cast("long")), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if (n or 0) == capped or free == 0:
            break
        capped, rate = n, (total - fixed) / free
    return rows.select("skey", "source_size", F.least(F.col("w") * F.lit(rate), F.col("cap")).alias("target"))


def _draw(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the shuffle hash ``h`` to rows (rid, source, size, text_md5): of
    seed and id.  Rows without an id draw by their text and, where that is
    equal too, by their number among its copies, so that they lie apart."""
    known = rows.filter("rid is not null").withColumn("h", _draw(seed, F.col("rid")))
    none = rank_within(rows.filter("rid is null").withColumn("skey", _source_key(F.col("source"))), ["skey", "text_md5"], ["size"], "copy")
    return known.unionByName(none.withColumn("h", _draw(seed, F.lit("null"), F.col("text_md5"), F.col("copy"))).drop("copy", "skey")).drop("text_md5")


def finish_times(docs: DataFrame, weights, share: float, most: int) -> DataFrame:
    """Adds skey, source_size, target, cum (words of the source's shuffled
    order up to and with the document) to rows (rid, source, size, h).

    The order is by the hash ``h``.  Sums of its 16^3 ranges give every range
    its offset, so no task holds more than a range of a source.
    """
    d = docs.withColumns({"skey": _source_key(F.col("source")), "part": F.substring("h", 1, PART_DIGITS)})
    parts = materialise(d.groupBy("skey", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    targets = fair_targets(parts.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size")
               .join(targets, "skey"))
    inside = Window.partitionBy("skey", "part").orderBy("h", "rid", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(offsets, ["skey", "part"])
            .withColumn("cum", F.col("ahead") + F.sum("size").over(inside))
            .drop("ahead", "part", "h"))


def _copies(most: int) -> Column:
    """Finish times of a document's copies, one a pass."""
    return F.array(*[(F.col("cum") + F.col("source_size") * e) / F.col("target") for e in range(most)])


def cut(placed: DataFrame, budget: float, most: int, ranges: int = RANGES) -> tuple[float, str]:
    """Finish time and source key of the last copy within the budget: the
    range that crosses it is found by range sums and cut again until few
    copies are left, which are then sorted."""
    copies = (placed.filter((F.col("size") > 0) & (F.col("target") > 0))
              .select("skey", "size", F.explode(_copies(most)).alias("v")))
    lo, hi = 0.0, copies.agg(F.max("v")).first()[0]
    if hi is None:
        return 0.0, ""
    below = 0
    while True:
        width = (hi - lo) / ranges
        inside = copies.filter((F.col("v") > F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        bins = (inside.withColumn("bin", F.least(F.lit(ranges - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int")))
                .groupBy("bin").agg(F.sum("size").alias("s"), F.count("*").alias("n"),
                                    F.min("v").alias("a"), F.max("v").alias("b")).orderBy("bin").collect())
        chosen = None
        for r in bins:  # at most `ranges` rows
            if below + r["s"] > budget:
                chosen = r
                break
            below += r["s"]
        if chosen is None:
            return hi, "2"  # everything fits
        if chosen["n"] <= FINAL_ROWS or chosen["a"] == chosen["b"] or width <= 0:
            break
        lo, hi = lo + chosen["bin"] * width, chosen["b"]
        lo = min(lo, chosen["a"] * (1 - 1e-15))
    last = (copies.filter(F.col("v").between(chosen["a"], chosen["b"]))
            .groupBy("v", "skey").agg(F.sum("size").alias("s"))
            .withColumn("c", F.sum("s").over(Window.orderBy("v", "skey")))
            .filter(F.col("c") + F.lit(below) <= F.lit(budget))
            .orderBy(F.desc("v"), F.desc("skey")).limit(1).collect())
    if last:
        return last[0]["v"], last[0]["skey"]
    return chosen["a"], ""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 17, ranges: int = RANGES) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies
    (passes taken), taken (size * copies), finish (first finish time).

    Null text has size 0 and is never taken; a null source is a source of its
    own, last; repeated rows count once each (equal rows are interchangeable);
    an empty table gives no rows; other columns are never read.  Equal seeds
    give equal results at any partitioning.
    """
    sized = materialise(docs.select(
        F.col(id_col).alias("rid"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("text_md5")), "mix-sizes")
    placed = materialise(finish_times(_drawn(sized, seed), weights, share, most), "mix-placed")
    budget = (placed.agg(F.sum("size")).first()[0] or 0) * share
    v, skey = cut(placed, budget, most, ranges)
    inside = lambda x: (x < F.lit(v)) | ((x == F.lit(v)) & (F.col("skey") <= F.lit(skey)))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(F.filter(_copies(most), inside))).otherwise(0)
    return placed.select(
        F.col("rid").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"),
        F.when(F.col("target") > 0, F.col("cum") / F.col("target")).alias("finish"))
