"""The corpus pipeline: each stage works on all its predecessor kept.

language ID -> SimHash near-dedup -> benchmark decontamination -> secret scans
-> mixing sources to target weights.  Every stage's rows are written as
Parquet to the shared folder and reread as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaprism.llm import decontam, language, mixing, secrets, simhash
from metaprism.functions.ranking import rank_within
from metaprism.llm.common import lookup, materialise, shared_path
from metaprism.session import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go, null, empty
    and letterless texts among them.  Repeated rows fare alike; an empty table
    stays empty.  Raises where no row outside the held-out ones has a language
    to learn, rather than reject all."""
    learn = docs.filter(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id")))
    if learn.filter("lang is not null and text is not null").isEmpty() and not docs.isEmpty():
        raise ValueError("no document has a language to learn from")
    judged = language.predictor(language.train(learn))(F.col("text"))
    return (docs.select(F.struct("*").alias("__row"), judged.alias("__p"))
            .filter(~F.col("__p.rejected")).select("__row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of smallest id, of
    equal ids that of lowest text hash, of repeated rows one.  Documents
    without a word are one group; a group of null ids keeps one of them."""
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, or a region of one, in their text.
    Null and empty texts stay; repeated rows fare alike; null and empty items
    match nothing; an empty benchmark leaves all."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars that
    of the new text.  Null and empty texts stay as they are; repeated rows and
    null ids each keep their row; an empty table stays empty."""
    ledger = secrets.create_ledger(spark)
    secrets.scan(docs, ledger)
    hits = secrets.findings(spark, ledger).filter(F.size("findings") > 0)
    rows = docs.select(F.struct("*").alias("__row"), secrets.blob_id(F.col("text")).alias("blob"))
    weights = rows.groupBy("blob").agg(F.count("*").alias("n"))
    joined = lookup(rows, hits.join(weights, "blob"), "blob", "n", how="left")
    text = F.when(F.col("findings").isNotNull(), secrets.redact(F.col("__row.text"), F.col("findings"))).otherwise(F.col("__row.text"))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return joined.withColumn("__text", text).select(
        *[(F.when(F.col("findings").isNotNull(), new[c]).otherwise(F.col("__row")[c]) if c in new else F.col("__row")[c]).alias(c)
          for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken, by virtual finish time, with columns
    epoch and finish (columns of these names are replaced).  Null and wordless
    texts have no size and are never taken; a null source is one of its own;
    of repeated rows each counts and is taken on its own; an empty table
    stays empty."""
    kept = [c for c in docs.columns if c not in ("epoch", "finish")]
    key = F.concat_ws(":", F.coalesce(F.concat(F.lit("id"), F.col("doc_id").cast("string")), F.lit("null")),
                      F.xxhash64("text").cast("string"), F.xxhash64("source").cast("string"))
    keyed = docs.select(F.struct(*kept).alias("__row"), key.alias("__key"))
    repeated = materialise(keyed.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1"), "mix-repeated")
    if not repeated.isEmpty():  # number the rows of one key, so that each has copies of its own
        found = lookup(keyed, repeated.withColumn("__many", F.col("__n")), "__key", "__n", how="left")
        again = rank_within(found.filter("__many is not null").drop("__many"), ["__key"], ["__key"], "__copy")
        keyed = (found.filter("__many is null").drop("__many")
                 .unionByName(again.select("__row", F.concat_ws(":", "__key", F.col("__copy").cast("string")).alias("__key"))))
        keyed = materialise(keyed, "mix-keyed")
    taken = (mixing.mix(keyed.select("__key", F.col("__row.text").alias("text"), F.col("__row.source").alias("source")), id_col="__key")
             .filter("copies > 0").select("__key", "copies", F.col("finish").alias("__finish"), (F.col("source_size") / F.col("target")).alias("__lap")))
    rows = keyed.join(taken, "__key").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = F.col("__finish") + F.col("__epoch") * F.col("__lap")
    return rows.select("__row.*", F.col("__epoch").alias("epoch"), finish.alias("finish")).orderBy("finish", "doc_id", "epoch")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]

#: The model of language ID and XXH64 fingerprints are beyond SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
