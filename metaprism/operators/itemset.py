"""Item-set meta-features (J1-J2) on the binary (one-hot) view of C.

one_itemset: share of rows holding each (column, value).
two_itemset: for values i of column a and j of column b (a before b), share of
rows where exactly one holds: (n_i + n_j - 2 n_ij) / n.  The level grid of a
column pair is formed by an equi-join of the two level lists on the pair key
(its size is the size of the output); observed co-occurrences come from the
pair contingency table.  Summaries need only how often each value occurs, which
``two_itemset_counts`` gives without the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, entry
from . import contingency as K


def ft_one_itemset(fr: Frame) -> DataFrame:
    n = float(fr.count())
    vc = K.value_counts(fr)
    pos = F.create_map(*[x for i, c in enumerate(fr.cat) for x in (F.lit(c), F.lit(i))])
    return vc.select(entry("one_itemset", F.col("cnt") / F.lit(n),
                           attr=F.concat_ws("=", "attr", "value"), idx=pos[F.col("attr")]).alias("e")).select("e.*")


def _pair_sides(fr: Frame) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """({(a, b): pair}, levels of the first column of every pair (pair, va, na),
    of the second (pair, vb, nb), observed cells (pair, va, vb, nab))."""
    cols = list(fr.cat)
    cells = K.pair_counts(fr, cols)
    vc = K.value_counts(fr)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    pos = {p: k for k, p in enumerate(pairs)}

    def side(which, value, cnt):
        of_pair = F.array(*[F.when(F.col("attr") == p[which], F.lit(k)) for p, k in pos.items()])
        return (vc.select(F.explode(of_pair).alias("pair"), F.col("value").alias(value), F.col("cnt").alias(cnt))
                .where(F.col("pair").isNotNull()))

    pair_id = F.create_map(*[x for (a, b), k in pos.items() for x in (F.lit(f"{a}|{b}"), F.lit(k))])
    obs = cells.select(pair_id[F.concat_ws("|", "a", "b")].alias("pair"), "va", "vb",
                       F.col("cnt").alias("nab"))
    return pos, side(0, "va", "na"), side(1, "vb", "nb"), obs


def ft_two_itemset(fr: Frame) -> DataFrame:
    n = float(fr.count())
    pos, side_a, side_b, obs = _pair_sides(fr)
    grid = side_a.join(side_b, "pair").join(obs, ["pair", "va", "vb"], "left")
    names = F.create_map(*[x for (a, b), k in pos.items() for x in (F.lit(k), F.lit(f"{a}|{b}"))])
    val = (F.col("na") + F.col("nb") - 2.0 * F.coalesce(F.col("nab"), F.lit(0.0))) / F.lit(n)
    attr = F.concat(names[F.col("pair")], F.lit(":"), F.col("va"), F.lit("|"), F.col("vb"))
    return grid.select(entry("two_itemset", val, attr=attr, idx=F.col("pair")).alias("e")).select("e.*")


def two_itemset_counts(fr: Frame) -> DataFrame:
    """(feature, value, n): how often each value of ``two_itemset`` occurs,
    without a row for a cell that no data row has.

    An absent cell's value is the sum of its levels' counts, so levels of equal
    counts make equal values: pairs are formed of distinct counts (at most
    sqrt(2 rows) of them a column, as they add up to the rows), with the product
    of their multiplicities.  Observed cells are then taken out of that sum and
    put in at their own value.  Counts are whole numbers, so both meet exactly.
    """
    _, side_a, side_b, obs = _pair_sides(fr)
    counts_a = side_a.groupBy("pair", "na").agg(F.count("*").alias("ha"))
    counts_b = side_b.groupBy("pair", "nb").agg(F.count("*").alias("hb"))
    both = F.col("na") + F.col("nb")
    every = counts_a.join(counts_b, "pair").select(both.alias("k"), (F.col("ha") * F.col("hb")).alias("n"))
    seen = obs.join(side_a, ["pair", "va"]).join(side_b, ["pair", "vb"]).select(F.inline(F.array(
        F.struct(both.alias("k"), F.lit(-1).cast("long").alias("n")),
        F.struct((both - 2.0 * F.col("nab")).alias("k"), F.lit(1).cast("long").alias("n")))))
    total = every.unionByName(seen).groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    return total.select(F.lit("two_itemset").alias("feature"), (F.col("k") / F.lit(float(fr.count()))).alias("value"), "n")


FEATURES = {"one_itemset": ft_one_itemset, "two_itemset": ft_two_itemset}
NEEDS_LABEL: set[str] = set()
