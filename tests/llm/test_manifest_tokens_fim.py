"""Merkle manifest, byte-level BPE and fill-in-the-middle against brute force,
SQL (in ``test_ops``) and exact round trips."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from metaprism.llm import bpe, fim, merkle
from metaprism.llm.queries import QUERIES

from llm_paths import SF001


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- 11 Merkle manifest ------------------------------------------------------

def brute_tree(leaves):
    """(root, proof of each leaf) by the plain rule."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            proofs[k].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], proofs


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> Counter of (id, leaf, subroot, root, proof)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(part(v) for v in r)), r[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(sources[s], key=lambda x: x[:3]),) for s in order}
    trees = {s: (leaves, *brute_tree([x[2] for x in leaves])) for s, (leaves,) in trees.items()}
    root, above = brute_tree([trees[s][1] for s in order])
    return Counter((x[3], x[2], trees[s][1], root, tuple(p + above[k]))
                   for k, s in enumerate(order) for x, p in zip(trees[s][0], trees[s][2]))


def proved(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["proof"])) for r in df.collect())


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("part_bits", [0, 2, 12])
def test_merkle_equals_brute_force(spark, part_bits):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "a", "a", None, "é", "z\U0001F600", ""]), None, i, f"text {i}\n") for i in range(400)]
    rows += [(i, f"lone{i:03}", "en", None, None) for i in range(400, 430)]
    draw.shuffle(rows)
    m = merkle.build(spark.createDataFrame(rows, DOC).repartition(5))
    got = merkle.prove(m, part_bits=part_bits)
    assert proved(got) == brute_manifest(rows)
    assert m.root() == got.first()["root"]
    assert got.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    some = m.leaves.filter("id % 17 = 3")
    assert proved(merkle.prove(m, some, part_bits=part_bits)) == Counter({k: v for k, v in brute_manifest(rows).items() if k[0] % 17 == 3})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 729, 730, 2188])
def test_merkle_sizes(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    assert proved(merkle.prove(merkle.build(spark.createDataFrame(rows, DOC)))) == brute_manifest(rows)


def test_merkle_edges(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert proved(merkle.prove(merkle.build(odd_docs))) == brute_manifest(rows)
    empty = merkle.build(odd_docs.limit(0))
    assert empty.root() is None and merkle.prove(empty).count() == 0


def test_merkle_missing_is_minimal():
    draw = random.Random(5)
    for _ in range(300):
        count = draw.randint(1, 200)
        known = sorted(draw.sample(range(count), draw.randint(1, count)))
        need = merkle.missing(np.array(known), count)
        have, level, m = set(known), 0, count
        while m > 1:
            runs = {i // 3 for i in have}
            want = {i for r in runs for i in range(3 * r, min(3 * r + 3, m))} - have
            assert set(need[level].tolist()) == want
            have, m, level = runs, -(-m // 3), level + 1
        assert len(need) == level


def test_merkle_hot_source_and_null_ids_are_spread(spark):
    """A source with most rows, ids null and rows equal: no range holds them all."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"),
                                  F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text")).repartition(6)
    m = merkle.build(df)
    sizes = [r["count"] for r in m.leaves.groupBy(F.shiftright("mid", 33)).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * 6000 / len(sizes)
    assert merkle.prove(m).filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_merkle_audit_finds_the_changed_texts(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_merkle"](spark, SF001).collect()}
    import zlib
    for r in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")
        assert got[r["doc_id"]]["verified"] == (not changed)


# --- 12 byte-level BPE -------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def whole(vocab):
    """Ids of a whole text by the library the ranks are made for."""
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


PARTS = ["a", "word ", "  ", "\n\n", "\t", " 's", "'ll", "''", "123", "4 5", "...!", "é", "日本語", "\U0001F600", "   \n x", "\x1c", " ", "\xa0",
         "x" * 40, " " * 40, "=" * 40, "7" * 40, "\n" * 40, "<|endoftext|>"]


def local(text, vocab, chunk, overlap):
    """Ids by the same steps on one text, without Spark."""
    parts = list(bpe.cut(text, chunk, overlap))
    sides = [bpe.boundaries(t, i, i == len(parts) - 1, vocab, chunk, overlap) for i, t in parts]
    cuts = [0]
    for (_, tail), (head, _) in zip(sides, sides[1:]):
        both = sorted(set(tail) & set(head))
        if not both:
            break
        cuts.append(both[0])
    return vocab.encode([text[a:b] for a, b in zip(cuts, [*cuts[1:], None])]).values.to_pylist(), len(cuts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=0, max_size=60), st.sampled_from([(8, 6), (16, 8), (32, 32), (60, 20)]))
def test_bpe_stitching_changes_nothing(vocab, whole, parts, sizes):
    text = "".join(parts)
    assert local(text, vocab, *sizes)[0] == whole(text)


def test_bpe_stitches_real_texts(spark, vocab, whole):
    longest = spark.read.parquet(f"{SF001}/documents.parquet").orderBy(F.desc(F.length("text"))).select("text").limit(20).collect()
    for r in longest:
        ids, pieces = local(r["text"], vocab, 256, 64)
        assert ids == whole(r["text"]) and pieces == max(1, -(-(len(r["text"]) - 64) // 256))


def test_bpe_on_spark(spark, vocab, whole):
    draw = random.Random(9)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 90))) for _ in range(150)] + ["x" * 5000, " " * 5000, "=" * 4000 + " a b c " * 600, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    coded = bpe.encode(rows, vocab, chunk=64, overlap=32)
    got = {r["doc_id"]: r for r in coded.withColumn("raw", bpe.decoder(vocab)(F.col("ids"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == whole(t or ""), t
        assert bytes(got[i]["raw"]) == (t or "").encode()


def test_bpe_query_equals_whole_texts(spark, whole):
    got = {r["doc_id"]: r for r in QUERIES["op12_bpe"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, g = whole(r["text"] or ""), got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(r["text"] or ""))


def test_bpe_edges(spark, odd_docs, vocab, whole):
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(odd_docs, vocab).collect())
    assert got == Counter((r["doc_id"], tuple(whole(r["text"] or ""))) for r in odd_docs.select("doc_id", "text").collect())
    assert bpe.encode(odd_docs.limit(0), vocab).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd_docs, vocab, chunk=10, overlap=20)


# --- 13 fill-in-the-middle ---------------------------------------------------

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows(df):
    rows = fim.restore(fim.transform(df)).collect()
    return Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in rows)


def fim_brute(rows):
    return Counter((i, *brute_fim(i, t), t or "") for i, t in rows)


def test_fim_equals_brute_force(spark):
    draw = random.Random(4)
    bits = ["a", "é", "日本", "\U0001F600", " ", "  ", "\n", "\t\x0b", "\xa0", "word", "<", "P>", "<P", "<M>", "<S", "S>", ">"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 30)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, " "), (9003, "x y " * 300_000)]
    assert fim_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == fim_brute(rows)


def test_fim_edges(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert fim_rows(odd_docs) == fim_brute(rows)
    assert fim.transform(odd_docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a é<>PSM\n", max_size=12), min_size=1, max_size=8), st.integers(1, 40), st.integers(0, 2**32))
def test_fim_kernel_round_trip(texts, step, seed):
    raw, off = fim.bytes_of(pa.array(texts))
    draws = np.random.default_rng(seed).integers(0, 2**32, (len(texts), 4))
    for a, b in fim.slices(off, step):
        moved, out_off, n, form, _, _ = fim.scatter(raw[off[a]:off[b]], off[a:b + 1] - off[a], draws[a:b], 90, 50)
        assert [len(TOKEN.findall(t)) for t in texts[a:b]] == n.tolist()
        assert fim.strings_of(*fim.gather(moved, out_off, form)).to_pylist() == texts[a:b]


def test_fim_restore_refuses_what_does_not_fit(spark):
    rows = [(1, "<P>a<S>b<M>c", "psm"), (2, "<S>b<P>a<M>c", "spm"), (3, "<P>a<S>b", "psm"), (4, "<S>b<P>a<M>c", "psm"), (5, "x<P>a<S>b<M>c", "psm"),
            (6, "<P>a<S>b<M>c", "plain"), (7, None, "plain"), (8, "<P>a<S>b<M>c", None), (9, "<P>a<S>b<M>c<M>", "psm")]
    got = {r["k"]: r["text"] for r in fim.restore(spark.createDataFrame(rows, "k int, output string, form string")).collect()}
    assert got == {1: "acb", 2: "acb", 3: None, 4: None, 5: None, 6: "<P>a<S>b<M>c", 7: "", 8: "<P>a<S>b<M>c", 9: None}
