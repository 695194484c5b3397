"""Merkle manifest of a dataset, with proofs made a leaf partition at a time.

Every row is a leaf; the leaves of a source, by id, form a tree in which each
run of three consecutive nodes becomes one; the sources' roots, by source,
form the top tree in the same way.  All nodes are kept in one table by their
coordinates (tree, level, place).

Proofs are made the way an octopus proof is: a partition of leaves works out
the minimal union of node coordinates that it cannot derive from its own
leaves, all partitions fetch theirs by one join, the partition derives the
interiors that its leaves share once, and every leaf's own proof is read off
them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

ARITY = 3
#: Levels that one round of grouping builds: 3^6 = 729 leaves a group.
LEVELS = 6
#: Leaves of a partition of proofs, as a power of two.
PART_BITS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the sources' roots; a source's tree is "0" for null, else "1" and its name.
TOP = ""


def digest_of(*inputs: Column) -> Column:
    """SHA-256 of the inputs concatenated, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest_of(*[field(c) for c in columns.values()])


def _numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` range-partitioned by tree and ``order``, written once, with
    ``mid``: partition and place in it, ascending over all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    # the written number of the row breaks ties, so that equal rows do not share a range
    fixed = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), f"{tag}-rows")
    return materialise(fixed.repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
                       .withColumn("mid", F.monotonically_increasing_id()), tag)


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``pos`` and ``n``, trees with ``n``): places of numbered rows
    in their tree and its size.  Offsets come from counts by range and tree,
    one row each, so a tree of any size is spread over many tasks."""
    rows = rows.withColumn("range", F.shiftright("mid", 33))
    counts = rows.groupBy("range", "tree").agg(F.count("*").alias("c"), F.min("mid").alias("low"))
    tree = Window.partitionBy("tree")
    before = F.sum("c").over(tree.orderBy("range")) - F.col("c")
    spans = counts.select("range", "tree", F.sum("c").over(tree).alias("n"), (before - F.col("low")).alias("shift"))
    placed = rows.join(spans, ["range", "tree"]).withColumn("pos", F.col("mid") + F.col("shift")).drop("range", "shift")
    return placed, counts.groupBy("tree").agg(F.sum("c").alias("n"))


def _up(nodes: Column, count: Column) -> Column:
    """The level above some consecutive nodes; none above a tree's last one."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    above = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))
    return F.when((count > 1) & (F.size(nodes) > 0), above).otherwise(F.array().cast("array<string>"))


def _levels(nodes: Column, n: Column, level: int, todo: int) -> Column:
    """Arrays of the next ``todo`` levels above ``nodes``, which are part of
    level ``level`` of a tree of ``n`` leaves."""
    count = F.ceil(n / F.lit(float(ARITY ** level)))
    return let(_up(nodes, count), lambda above: F.array(above) if todo == 1 else
               F.concat(F.array(above), _levels(above, n, level + 1, todo - 1)))


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, digest, n) of all nodes above the leaves, given as
    (tree, pos, n, digest).  A round builds ``LEVELS`` levels from groups of
    consecutive nodes; it needs no more rounds than the highest tree."""
    out, base = None, leaves.select("tree", F.col("pos").alias("idx"), "n", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, group = 0, ARITY ** LEVELS
    while ARITY ** level < most:
        blocks = base.groupBy("tree", F.expr(f"idx div {group}").alias("block")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda s: s["digest"]).alias("nodes"), F.first("n").alias("n"))
        built = blocks.select("tree", "n", "block", F.posexplode(_levels(F.col("nodes"), F.col("n"), level, LEVELS)).alias("up", "above"))
        width = F.element_at(F.array(*[F.lit(group // ARITY ** (i + 1)).cast("long") for i in range(LEVELS)]), F.col("up") + 1)
        nodes = materialise(built.select("tree", "n", (F.col("up") + level + 1).alias("level"), (F.col("block") * width).alias("low"), F.posexplode("above").alias("i", "digest"))
                            .select("tree", "level", (F.col("low") + F.col("i")).alias("idx"), "digest", "n"), "merkle-nodes")
        out = nodes if out is None else out.unionByName(nodes)
        level += LEVELS
        base = nodes.filter(F.col("level") == level).select("tree", "idx", "n", "digest")
    zero = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest", "n")
    return zero if out is None else zero.unionByName(out)


@dataclass
class Manifest:
    """``leaves``: id, digest, carried columns and coordinates of every row;
    ``nodes``: (tree, level, idx, digest); ``sources``: the top tree's leaves."""
    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    id_col: str

    def root(self) -> str | None:
        """The dataset's root; null for an empty one."""
        top = self.nodes.filter(F.col("tree") == TOP).orderBy(F.desc("level"), "idx").first()
        return top["digest"] if top else None


def build(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple = COLUMNS,
          carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` over ``columns``; ``carry`` adds columns of the
    row to its leaf.

    Leaves ascend by id, null first; rows of one id by their digest, and equal
    rows are leaves of equal digests.  Nulls of any column are ``-`` in the
    digest, apart from every text; other columns are never read; an empty
    table has no leaves and no root.
    """
    source = F.col(source_col)
    tree = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))
    leaf = leaf_of({c: F.col(c) for c in columns})
    rows = docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf.alias("digest"),
                       *[c.alias(f"carry_{name}") for name, c in (carry or {}).items()])
    placed, trees = _placed(_numbered(rows, ["id", "digest"], "merkle-leaves"))
    leaves = materialise(placed, "merkle-leaves")
    nodes = tree_nodes(leaves.select("tree", "pos", "n", "digest"))
    last = F.col("n") > F.pow(F.lit(float(ARITY)), F.col("level") - 1)
    roots = nodes.filter((F.col("idx") == 0) & F.when(F.col("level") == 0, F.col("n") == 1).otherwise(
        last & (F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level")))))
    top, _ = _placed(_numbered(roots.select(F.col("tree").alias("of"), "digest").withColumn("tree", F.lit(TOP)), ["of"], "merkle-top"))
    sources = materialise(top.select("tree", "of", "digest", "pos", "n"), "merkle-sources")
    every = nodes.unionByName(tree_nodes(sources)).select("tree", "level", "idx", "digest")
    return Manifest(leaves, every, sources, id_col)


def missing(known: np.ndarray, count: int) -> list[np.ndarray]:
    """Octopus: by level, the places of the nodes that the known leaves'
    proofs need and that neither are known nor follow from known ones."""
    out, known = [], np.unique(known)
    while count > 1:
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(members[members < count], known, assume_unique=True))
        known, count = runs, -(-count // ARITY)
    return out


def derive(known: dict[int, str], count: int, fetched: dict[tuple[int, int], str]) -> tuple[str, list[dict]]:
    """(root, by level {place: (digests of the run before it, after it)}) of a
    tree of ``count`` leaves from some leaves and the fetched nodes."""
    levels, level = [], 0
    while count > 1:
        sides, above = {}, {}
        for run in {i // ARITY for i in known}:
            members = range(run * ARITY, min((run + 1) * ARITY, count))
            digests = [known[i] if i in known else fetched[level, i] for i in members]
            for k, i in enumerate(members):
                if i in known:
                    sides[i] = "".join(digests[:k]), "".join(digests[k + 1:])
            above[run] = hashlib.sha256("".join(digests).encode()).hexdigest()
        levels.append(sides)
        known, count, level = above, -(-count // ARITY), level + 1
    return known[0], levels


def _read_off(place: int, levels: list[dict]) -> list[tuple[str, str]]:
    out = []
    for sides in levels:
        out.append(sides[place])
        place //= ARITY
    return out


def _needed(table: pa.Table) -> pa.Table:
    """Coordinates that the leaves of one partition lack, in all their trees."""
    rows = table.select(["tree", "pos", "n", "top_pos", "top_n"]).to_pandas()
    found = []
    for tree, part in rows.groupby("tree", sort=False):
        found += [(tree, level, at) for level, at in enumerate(missing(part["pos"].to_numpy(), int(part["n"].iloc[0])))]
    found += [(TOP, level, at) for level, at in enumerate(missing(rows["top_pos"].unique(), int(rows["top_n"].iloc[0])))]
    sizes = [len(at) for _, _, at in found]
    return pa.table({
        "part": pa.array(np.repeat(table["part"][0].as_py(), sum(sizes)), pa.int64()),
        "tree": pa.array([t for t, _, at in found for _ in at], pa.string()),
        "level": pa.array(np.repeat([k for _, k, _ in found], sizes), pa.int32()),
        "idx": pa.array(np.concatenate([at for _, _, at in found]) if found else [], pa.int64())})


_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _proofs(table: pa.Table, nodes: pa.Table) -> pa.Table:
    """The partition's leaves with subroot, root and proof."""
    fetched: dict = {}
    for tree, level, idx, digest in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "idx", "digest"))):
        fetched.setdefault(tree, {})[level, idx] = digest
    leaves = list(zip(*(table[c].to_pylist() for c in ("tree", "pos", "digest", "n", "top_pos", "top_n"))))
    own: dict = {}
    for tree, pos, digest, n, top_pos, top_n in leaves:
        own.setdefault(tree, (n, top_pos, {}))[2][pos] = digest
    derived = {tree: derive(known, n, fetched.get(tree, {})) for tree, (n, _, known) in own.items()}
    root, top = derive({own[tree][1]: subroot for tree, (subroot, _) in derived.items()}, leaves[0][5], fetched.get(TOP, {}))
    above = {tree: _read_off(own[tree][1], top) for tree in own}
    proofs = [[{"left": a, "right": b} for a, b in _read_off(pos, derived[tree][1]) + above[tree]] for tree, pos, *_ in leaves]
    kept = table.select([c for c in table.column_names if c in ("id", "digest") or c.startswith("carry_")])
    return (kept.append_column("subroot", pa.array([derived[r[0]][0] for r in leaves], pa.string()))
            .append_column("root", pa.array([root] * len(leaves), pa.string()))
            .append_column("proof", pa.array(proofs, _PROOF)))


def prove(manifest: Manifest, leaves: DataFrame | None = None, part_bits: int = PART_BITS) -> DataFrame:
    """(id, leaf, carried columns, subroot, root, proof) of the given leaves
    (some rows of ``manifest.leaves``; all by default).

    A proof is an array from leaf to root of the digests to the left and right
    of the node in its run; a level where the node is alone has two empty ones.
    """
    rows = manifest.leaves if leaves is None else leaves
    top = manifest.sources.select(F.col("of").alias("tree"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"))
    # a partition holds leaves that follow each other, of one tree or of many small ones
    rows = rows.withColumn("part", F.shiftright("mid", part_bits))
    by_part = rows.groupBy("part", "tree").agg(F.count("*").alias("c")).join(top, "tree").drop("c")
    rows = rows.join(by_part, ["part", "tree"])
    needed = rows.select("part", "tree", "pos", "n", "top_pos", "top_n").groupBy("part").applyInArrow(
        _needed, "part long, tree string, level int, idx long")
    fetched = needed.join(manifest.nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    id_type = rows.schema["id"].dataType.simpleString()
    carried = [f for f in rows.schema.fields if f.name.startswith("carry_")]
    kept = ["id", "digest", *[f.name for f in carried]]
    schema = ", ".join([f"id {id_type}", "digest string", *[f"{f.name} {f.dataType.simpleString()}" for f in carried],
                        "subroot string", "root string", "proof array<struct<left:string,right:string>>"])
    out = rows.select(*kept, "part", "tree", "pos", "n", "top_pos", "top_n").groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_proofs, schema)
    return out.select(F.col("id").alias(manifest.id_col), F.col("digest").alias("leaf"),
                      *[F.col(f.name).alias(f.name.removeprefix("carry_")) for f in carried], "subroot", "root", "proof")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, run: F.sha2(F.concat(run["left"], acc, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Every row's proof, held against a copy of the table in which the texts
    of some rows (even CRC-32 of the id in decimal digits) lost their line
    feeds; a null id is never among them."""
    text = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = leaf_of({c: text if c == "text" else F.col(c) for c in COLUMNS})
    found = prove(build(docs, carry={"claim": claim}))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                        fold(F.col("claim"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
