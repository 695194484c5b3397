"""Personal data by candidate gradient boosting (DataFrame and ML operations
only).

Exact patterns with validity checks give the base spans.  High-recall
generators propose further, overlapping spans; boosted trees score them by
format and context; a threshold per kind, calibrated on rows the trees did not
see, selects the ones that are redacted beside the base spans.  The trees are
trained on the whole corpus itself: candidates that are a base span are positive.
What lies inside a longer match that the base patterns dropped (a telephone
number with a card number right behind it is one run of digits to them) has no
label; nor have forms that no base pattern knows, an address with (at) or a
telephone number without + behind a cue.  These are what the trees add; they
learn such forms from base spans rewritten that way.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPANS, count_kind, in_order, let, materialise, no_spans, regex_spans, span_string

KINDS = ("email", "ip", "card", "phone")

# A match starts at the head of a run of its characters or where the last one
# ended; that finds the same matches without trying every character of a run.
_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    digits = F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != "")

    def worth(c, i):
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


#: kind -> (where it can occur at all, pattern, what makes a match valid)
BASE = {
    "email": (lambda t: t.contains("@"), _EMAIL, None),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _IP, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _CARD,
             lambda m: F.length(_digits(m)).between(12, 19) & luhn(m)),
    "phone": (lambda t: t.contains("+"), _PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
}
#: (kind, where, high-recall pattern); their spans overlap each other.
GENERATORS = (
    ("email", lambda t: t.contains("@") | t.rlike(r"[(\[](?i:at)[)\]]"),
     r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[(\[](?i:at)[)\]])\x20?"
     r"[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]++)*+"),
    ("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++)++"),
    ("card", lambda t: t.rlike(r"[0-9](?:[\x20.-]?[0-9]){8}"), r"[0-9](?:[\x20.-]?[0-9]){8,}+"),
    # these three also find a number that other digits follow or precede
    ("card", lambda t: t.rlike(r"[0-9]{12}"), r"(?<![0-9])[0-9]{12,19}+(?![0-9])"),
    ("card", lambda t: t.rlike(r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"), r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"),
    ("phone", lambda t: t.contains("+"),
     r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2}(?![0-9])"),
    ("phone", lambda t: t.rlike(r"[0-9][\x20().0-9-]{6}"), r"[+(]?[0-9][\x20().0-9-]{5,}[0-9]"),
)
FEATURES = ("kind", "length", "digits", "letters", "dots", "hyphens", "spaces", "parens", "plus", "at",
            "groups", "distinct", "first", "left_alnum", "right_alnum", "cue", "valid")
#: Words before a span that tell its kind.
CUES = {"email": r"(?i)mail|contact", "ip": r"(?i)host|addr|\bip\b", "card": r"(?i)card|visa", "phone": r"(?i)phone|tel|call|fax|contact"}
CONTEXT = 24


def _spans(text: Column, kind: str, where, pattern: str, ok=None) -> Column:
    return F.when(where(text), regex_spans(text, pattern, kind, KINDS.index(kind), ok)).otherwise(no_spans())


def raw_spans(text: Column) -> Column:
    """Matches of the four base patterns, valid or not."""
    return F.concat(*[_spans(text, k, *BASE[k][:2]) for k in KINDS])


def _valid(s: Column) -> Column:
    """Whether a span's match passes its kind's check."""
    out = F.lit(True)
    for i, k in enumerate(KINDS):
        if BASE[k][2] is not None:
            out = F.when(s["ord"] == i, BASE[k][2](s["match"])).otherwise(out)
    return out


def base_spans(text: Column) -> Column:
    """Valid spans of the four kinds, in order."""
    return in_order(F.filter(raw_spans(text), _valid))


def _left(text: Column, s: Column) -> Column:
    return F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))


def _cue(text: Column, s: Column) -> Column:
    """Whether a word before the span tells its kind."""
    out = F.lit(False)
    for i, k in enumerate(KINDS):
        out = F.when(s["ord"] == i, _left(text, s).rlike(CUES[k])).otherwise(out)
    return out


def _new_form(text: Column, s: Column) -> Column:
    """Whether a span has a form that the base patterns do not know, and passes
    for its kind: an address with (at) and a dot, a telephone number without +
    of valid length behind a cue."""
    m = s["match"]
    address = (s["kind"] == "email") & m.rlike(r"[(\[](?i:at)[)\]].*(?:\.|[(\[](?i:dot)[)\]])")
    return address | ((s["kind"] == "phone") & ~m.startswith("+") & _valid(s) & _cue(text, s))


def _rewritten(s: Column) -> Column:
    """A base span in the forms that the base patterns do not know."""
    m = s["match"]
    form = lambda x: F.struct(s["start"], s["ord"], s["end"], s["kind"], x.alias("match"))
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    forms = F.when(s["kind"] == "email", F.array(
        form(F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) ")))), form(F.concat(name, F.lit("(at)"), host))))
    forms = forms.when(s["kind"] == "phone", F.array_distinct(F.array(
        form(F.substring(m, 2, 1 << 20)), form(F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]", "")))))
    return F.filter(F.coalesce(forms, no_spans()), lambda x: ~x["match"].startswith("+") & _valid(x))


def _features(text: Column, s: Column) -> Column:
    m = s["match"]
    count = lambda chars: (F.length(m) - F.length(F.translate(m, chars, ""))).cast("double")
    left = _left(text, s)
    right = F.substring(text, s["end"] + 1, F.lit(1))
    return F.array(
        s["ord"].cast("double"), F.length(m).cast("double"), count("0123456789"),
        F.length(F.regexp_replace(m, r"[^A-Za-z]", "")).cast("double"), count("."), count("-"), count(" "), count("()[]"),
        count("+"), count("@"), F.size(F.split(m, r"[^0-9A-Za-z]+")).cast("double"),
        F.size(F.array_distinct(F.split(_digits(m), ""))).cast("double"),
        F.ascii(m).cast("double"),
        left.rlike(r"[0-9A-Za-z]$").cast("double"), right.rlike(r"[0-9A-Za-z]").cast("double"),
        _cue(text, s).cast("double"),
        _valid(s).cast("double"))


CANDIDATE = "struct<start:int,ord:int,end:int,kind:string,match:string,x:array<double>,y:double>"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, base, cands, forms): base spans; proposed spans with features x
    and silver label y: 1 for a base span, null (unknown) inside a longer match
    that the base patterns dropped and in a new form, else 0; and (kind, match,
    start, x) of base spans rewritten in new forms, telephone numbers behind a
    cue only."""
    text = F.col("text")
    spans = (docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .select("rid", "text", raw_spans(text).alias("raw"),
                     F.array_distinct(F.concat(*[_spans(text, *g) for g in GENERATORS])).alias("more"))
             .select("rid", "text", "more", in_order(F.filter("raw", _valid)).alias("base"),
                     F.filter("raw", lambda r: ~_valid(r)).alias("dropped")))

    def label(s):
        same = F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] == s["start"]) & (b["end"] == s["end"]))
        within = F.exists("dropped", lambda d: (d["start"] <= s["start"]) & (s["end"] <= d["end"])
                          & (d["end"] - d["start"] > s["end"] - s["start"]))
        return F.when(same, 1.0).when(within | _new_form(text, s), F.lit(None)).otherwise(0.0)

    return spans.select("rid", "base", F.transform("more", lambda s: F.struct(
        s["start"], s["ord"], s["end"], s["kind"], s["match"], _features(text, s), label(s).cast("double"))
        .cast(CANDIDATE)).alias("cands"),
        F.transform(F.flatten(F.transform(F.filter("base", lambda b: (b["kind"] == "email") | ((b["kind"] == "phone") & _cue(text, b))), _rewritten)),
                    lambda s: F.struct(s["kind"], s["match"], s["start"], _features(text, s).alias("x"))).alias("forms"))


def _tree(node, x: Column) -> Column:
    """A fitted tree as a CASE expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    at = node.split()
    return (F.when(x[at.featureIndex()] <= F.lit(float(at.threshold())), _tree(node.leftChild(), x))
            .otherwise(_tree(node.rightChild(), x)))


def score(model, x: Column) -> Column:
    """Probability of personal data under the boosted trees."""
    margin = sum((F.lit(float(w)) * _tree(t._call_java("rootNode"), x)
                  for t, w in zip(model.trees, model.treeWeights)), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def fit(found: DataFrame, trees: int, depth: int, precision: float):
    """(model, {kind: threshold}) from all labelled candidates; a quarter of
    them, by hash, only calibrates.  Equal ones are one row with their number as
    weight, so copies cost nothing.  A kind whose scores never
    reach ``precision`` adds nothing; without both labels there is no model."""
    known = found.select(F.explode("cands").alias("c")).filter("c.y is not null")
    forms = found.select(F.explode("forms").alias("f")).select(F.struct("f.*", F.lit(1.0).alias("y")).alias("c"))
    columns = ("kind", "match", "start", "x", "y")
    rows = materialise(
        known.select(F.struct(*[F.col(f"c.{k}").alias(k) for k in columns]).alias("c")).unionByName(forms)
        .groupBy("c.kind", "c.x", "c.y", (F.pmod(F.xxhash64("c.match", "c.start"), F.lit(4)) == 0).alias("held"))
        .agg(F.count("*").cast("double").alias("n")).sortWithinPartitions("kind", "x", "y", "held"), "pii-fit")
    training = rows.filter("not held").select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "n").cache()
    try:
        if training.select("label").distinct().count() < 2:
            return None, {}
        # MLlib proposes splits from maxBins ** 2 rows: so many bins that these are all
        bins = max(32, math.isqrt(training.count()) + 1)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=bins, weightCol="n").fit(training)
    finally:
        training.unpersist()
    steps = (rows.filter("held").select("kind", F.floor(score(model, F.col("x")) * 100).cast("int").alias("step"), "y", "n")
             .groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("hits")).collect())  # <= 4 x 101 rows
    thresholds = {}
    for kind in KINDS:
        n = hits = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            n, hits = n + r["n"], hits + r["hits"]
            if hits >= precision * n:
                thresholds[kind] = r["step"] / 100
    return model, thresholds


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlap(scored: Column) -> Column:
    """Spans of (p, c), best score first (then place): each that meets none
    taken before."""
    best = F.array_sort(F.transform(scored, lambda s: F.struct(
        (-s["p"]).alias("p"), F.struct(s["c"]["start"], s["c"]["ord"], -s["c"]["end"]).alias("place"), s["c"].alias("c"))))
    return F.aggregate(best, no_spans(), lambda taken, s: F.when(F.exists(taken, lambda o: _meets(o, s["c"])), taken).otherwise(
        F.concat(taken, F.array(F.struct(*[s["c"][k].alias(k) for k in ("start", "ord", "end", "kind", "match")])).cast(SPANS))))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           trees: int = 12, depth: int = 4, precision: float = 0.95) -> DataFrame:
    """(id, base, spans): the base spans, and all spans with the selected
    candidates that overlap no base span (best score first, each that meets none taken before).

    Null or empty texts have no spans; repeated rows and null ids each keep
    their row; an empty table gives no rows; other columns are never read.
    """
    found = materialise(candidates(docs, id_col, text_col), "pii-candidates")
    model, thresholds = fit(found, trees, depth, precision)
    if not thresholds:
        return found.select(F.col("rid").alias(id_col), "base", F.col("base").alias("spans"))
    least = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(float(thresholds.get(k, 2.0)))) for k in KINDS])
    scored = F.transform(F.filter("cands", lambda c: ~F.exists("base", lambda b: _meets(c, b))),
                         lambda c: F.struct(score(model, c["x"]).alias("p"), c.alias("c")))
    chosen = F.filter(scored, lambda s: s["p"] >= least(s["c"]["kind"]))
    added = without_overlap(chosen)
    return found.select(F.col("rid").alias(id_col), "base",
                        in_order(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The per-document result columns of the registered query."""
    return found.select(F.col(id_col), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(span_string(F.col("base")), 256).alias("base_sha256"),
                        span_string(F.col("spans")).alias("spans"))
