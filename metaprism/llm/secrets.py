"""Secret scans with an incremental blob ledger (DataFrame operations only).

Every historical version of a text is content-addressed (SHA-256).  A ledger
table in the shared folder records, per blob, which rule versions have seen it
and what they found.  A scan reads only the (blob, rule version) pairs that
the ledger lacks, appends them, and joins the findings back to every path that
carries the blob.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_kind, in_order, let, lookup, materialise, no_spans, regex_spans, shared_path, span_string

_VALUE = r"[A-Za-z0-9+/_.=-]+"
_KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = rf"{_KEYWORD}[\"']?\x20*[:=]\x20*[\"']?({_VALUE})"

# A PEM key up to its END line; without one, its header and base64 lines (line
# ends also as \n of quoted code).  Possessive, so that no text is tried twice.
_BREAK = r"(?:[\s>\"']|\\[nrt])"
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
        r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
        rf"|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[\x20A-Za-z0-9,-]*+)*+"
        rf"(?:{_BREAK}*+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)*+"
        rf"(?:{_BREAK}++[A-Za-z0-9+/]++={{1,2}}+|[\x20\t\r]*+\n[A-Za-z0-9+/]++(?=[\x20\t\r]*+(?:\n|\z)))?+)")

#: What the ledger keeps of a finding: where it is, never what it says.
FOUND = "array<struct<start:int,ord:int,end:int,kind:string>>"
LEDGER_SCHEMA = f"blob string, rules array<string>, findings {FOUND}"
#: Blobs that may be broadcast for a scan; their number is counted first.
FEW_BLOBS = 50_000


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; ``hint`` is a cheap test that must hold where
    the pattern matches, ``ok`` drops failing matches, ``base`` marks the
    contract's kinds."""
    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    ok: Callable[[Column], Column] | None = None
    version: int = 1
    base: bool = False

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order of the span strings.
RULES = (
    Rule("assign", _ASSIGN, lambda t: t.rlike(_KEYWORD + r"[\"']?\x20*[:=]"),
         lambda m: F.length(F.regexp_extract(m, _ASSIGN, 1)) >= 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda t: t.contains("AKIA"), lambda m: F.length(m) >= 20, base=True),
    # A run shorter than 24 cannot match, a longer one matches from its start.
    Rule("hex", r"[0-9a-f]{24,}", lambda t: t.rlike(r"[0-9a-f]{24}"), base=True),
    Rule("private_key", _PEM, lambda t: t.contains("PRIVATE KEY-----"), version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}", lambda t: t.contains(".eyJ")),
)


def create_ledger(spark: SparkSession, path: str | None = None) -> str:
    """An empty ledger table at ``path`` (default: a fresh shared folder)."""
    path = path or shared_path(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(path)
    return path


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def blob_id(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: str, text_col: str = "text", rules=RULES) -> DataFrame:
    """One row (blob, text, todo) per distinct blob with rule versions that the
    ledger has not recorded.

    With an empty ledger every blob is new and copies collapse before the
    shuffle.  Else the blobs' ids alone meet the ledger, and only texts with
    something to do leave their tasks."""
    spark = versions.sparkSession
    every = F.array(*[F.lit(r.id) for r in rules])
    rows = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = _ledger(spark, ledger)
    if kept.isEmpty():
        return rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every).filter(F.size("todo") > 0)
    seen = kept.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    ids = rows.groupBy("blob").agg(F.count("*").alias("n"))
    todo = materialise(ids.join(seen, "blob", "left").select("blob", "n", F.when(F.col("seen").isNull(), every).otherwise(
        F.array_except(every, F.col("seen"))).alias("todo")).filter(F.size("todo") > 0), "secret-todo")
    found = rows.join(F.broadcast(todo.drop("n")), "blob") if todo.count() <= FEW_BLOBS else lookup(rows, todo, "blob", "n")
    return found.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan(versions: DataFrame, ledger: str, text_col: str = "text", rules=RULES) -> None:
    """Scan the unseen (blob, rule version) pairs and append them to the ledger.
    A failed run appends nothing, so it can be repeated."""
    todo = unseen(versions, ledger, text_col, rules)
    text = F.col("text")
    parts = [F.when(F.array_contains("todo", r.id) & r.hint(text),
                    regex_spans(text, r.pattern, r.kind, i, r.ok)).otherwise(no_spans())
             for i, r in enumerate(rules)]
    where = F.transform(in_order(F.concat(*parts)), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])).cast(FOUND)
    (todo.select("blob", F.col("todo").alias("rules"), where.alias("findings"))
     .write.mode("append").parquet(ledger))


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(blob, findings) over the current rule versions, one row per blob."""
    current = F.array(*[F.lit(r.id) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    rows = (_ledger(spark, ledger)
            .withColumn("now", F.array_intersect("rules", current))
            .withColumn("kinds", F.filter(kinds, lambda k: F.exists(
                F.col("now"), lambda r: F.substring_index(r, "@", 1) == k)))
            .select("blob", F.filter("findings", lambda s: F.array_contains(F.col("kinds"), s["kind"])).alias("f")))
    return rows.groupBy("blob").agg(in_order(F.array_distinct(F.flatten(F.collect_list("f")))).alias("findings"))


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  ledger: str | None = None, rules=RULES) -> DataFrame:
    """(id, blob, findings): one row per version, after bringing the ledger up
    to date.  ``ledger`` names a kept table; by default a fresh one is used.

    Null or empty texts are the empty blob without findings; repeated rows and
    null ids each keep their row; an empty table gives no rows; other columns
    are never read."""
    spark = versions.sparkSession
    ledger = create_ledger(spark, ledger)
    scan(versions, ledger, text_col, rules)
    paths = materialise(versions.select(F.col(id_col).alias(id_col), blob_id(F.col(text_col)).alias("blob")),
                        "secret-paths")
    weights = paths.groupBy("blob").agg(F.count("*").alias("n_paths"))
    table = weights.join(findings(spark, ledger, rules), "blob")
    return lookup(paths, materialise(table, "secret-findings"), "blob", "n_paths")


def digest(found: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """The per-document result columns of the registered query."""
    base = F.array(*[F.lit(r.kind) for r in rules if r.base])
    f = F.col("findings")
    return found.select(
        F.col(id_col),
        *[count_kind(f, r.kind).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(span_string(F.filter(f, lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        span_string(f).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    def step(acc, s):
        return (F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(
        F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step),
        lambda r: F.concat(r["out"], F.substring(text, r["at"] + 1, F.length(text)))))
