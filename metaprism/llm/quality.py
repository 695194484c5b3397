"""Quality rules by weak supervision.

Every rule votes good (1) or bad (-1) on a text or abstains (0).
Expectation-maximisation over the vote patterns of the whole corpus estimates
the prior and how often each rule is right about good and about bad texts; the
posterior probability of good quality replaces a filter that asks all rules to
pass.  Texts that fail the hard base rules are never kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_letters", "n_upper", "n_distinct_words", "n_plain_words", "n_marked_words")
_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: A word of text: letters or digits, then at most one mark of punctuation.
_PLAIN = re.compile(rb"[\"'(]?[0-9A-Za-z\x80-\xff](?:[0-9A-Za-z\x80-\xff'-]*[0-9A-Za-z\x80-\xff])?[.,;:!?)\"']?")
#: Runs of marks that prose does not have.
_MARKED = re.compile(rb"[#*$%&|<>~^=_]|!!")
_LOWER = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyz")


def measure(text: str | None) -> tuple:
    """The COUNTS of a text (null: all zero)."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()  # splits at ASCII white space
    n = len(words)
    lines, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            n_lines += 1
            if line in lines:
                dup += 1
            lines.add(line)
    repeat, windows = 0, list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        covered = np.zeros(n, bool)
        at = np.array([i for i, w in enumerate(windows) if w in twice])
        for k in range(3):
            covered[at + k] = True
        repeat = int(covered.sum())
    size, distinct = len(text), Counter(words)
    upper, lower = size - len(text.translate(_UPPER)), size - len(text.translate(_LOWER))
    return (n, size - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeat,
            n_lines, upper + lower, upper, len(distinct),
            sum(k for w, k in distinct.items() if _PLAIN.fullmatch(w)),
            sum(k for w, k in distinct.items() if _MARKED.search(w)))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``value`` is in the bad zone, good in the good zone;
    between the zones, and where ``applies`` is false, it abstains."""
    name: str
    value: Callable[[], Column]
    good: Callable[[Column], Column]
    bad: Callable[[Column], Column]
    applies: Callable[[], Column] = lambda: F.lit(True)

    def vote(self) -> Column:
        v = self.value()
        return F.when(~self.applies(), 0).when(self.bad(v), -1).when(self.good(v), 1).otherwise(0).cast("tinyint")


def _ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a) / F.greatest(F.col(b), F.lit(1))


#: The votes, each from one or two counts.
RULES = (
    Rule("symbols", _ratio("n_symbols", "n_words"), lambda v: v < 0.02, lambda v: v > 0.1),
    Rule("marked_words", _ratio("n_marked_words", "n_words"), lambda v: v < 0.05, lambda v: v > 0.2),
    Rule("plain_words", _ratio("n_plain_words", "n_words"), lambda v: v > 0.9, lambda v: v < 0.6),
    Rule("letters", _ratio("n_letters", "word_chars"), lambda v: v > 0.93, lambda v: v < 0.88),
    Rule("repeats", _ratio("n_repeat_words", "n_words"), lambda v: v < 0.1, lambda v: v > 0.3),
    Rule("duplicate_lines", _ratio("n_dup_lines", "n_lines"), lambda v: v < 0.05, lambda v: v > 0.25, lambda: F.col("n_lines") >= 3),
    Rule("word_length", _ratio("word_chars", "n_words"), lambda v: v.between(4.5, 7.5), lambda v: (v < 3.8) | (v > 9)),
    Rule("capitals", _ratio("n_upper", "n_letters"), lambda v: v < 0.15, lambda v: v > 0.35, lambda: F.col("n_letters") >= 20),
    Rule("variety", _ratio("n_distinct_words", "n_words"), lambda v: v > 0.4, lambda v: v < 0.1, lambda: F.col("n_words") >= 20),
)


@dataclass(frozen=True)
class Supervision:
    """Prior of good, and per rule P(votes good | good), P(votes bad | bad)
    among its votes."""
    prior: float
    good: tuple
    bad: tuple


def estimate(patterns: list, counts: list, n_rules: int, steps: int = 200, tol: float = 1e-9) -> Supervision:
    """EM over vote patterns (at most 3^rules, whatever the input).  Counts of
    right and wrong votes carry a weak prior, so a rule that never votes stays
    at 0.8 and none becomes certain."""
    v, w = np.array(patterns, float).reshape(-1, n_rules), np.array(counts, float)
    prior, good, bad = 0.8, np.full(n_rules, 0.8), np.full(n_rules, 0.8)
    yes, no = v > 0, v < 0
    for _ in range(steps):
        lg = np.log(prior) + yes @ np.log(good) + no @ np.log(1 - good)
        lb = np.log(1 - prior) + no @ np.log(bad) + yes @ np.log(1 - bad)
        p = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        g, b = w * p, w * (1 - p)
        new_prior = (g.sum() + 8) / (w.sum() + 10)
        new_good = (g @ yes + 8) / (g @ (yes | no) + 10)
        new_bad = (b @ no + 8) / (b @ (yes | no) + 10)
        moved = max(abs(new_prior - prior), np.abs(new_good - good).max(), np.abs(new_bad - bad).max())
        prior, good, bad = new_prior, new_good, new_bad
        if moved < tol:
            break
    return Supervision(float(prior), tuple(map(float, good)), tuple(map(float, bad)))


def fit(voted: DataFrame, rules=RULES) -> Supervision:
    names = [f"v_{r.name}" for r in rules]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n_rows")).orderBy(*names).collect()
    return estimate([[r[n] for n in names] for r in rows], [r["n_rows"] for r in rows], len(rules))


def posterior(model: Supervision, rules=RULES) -> Column:
    """Posterior probability of good quality, from the vote columns."""
    log_odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for r, g, b in zip(rules, model.good, model.bad):
        v = F.col(f"v_{r.name}")
        log_odds = log_odds + F.when(v > 0, float(np.log(g / (1 - b)))).when(v < 0, float(np.log((1 - g) / b))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
          min_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """(id, COUNTS, votes, posterior, base_failed, kept) per row.

    Null and empty texts have zero counts and fail the base rules; repeated
    rows and null ids each keep their row and count in the estimates; an empty
    table gives no rows; other columns are never read.  The text is read once:
    counts go to the shared folder, the estimates and posteriors come from
    them.
    """
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts.tolist()], columns=COUNTS)

    counter = F.pandas_udf(count, ", ".join(f"{c} long" for c in COUNTS)).asNondeterministic()
    rows = (docs.select(F.col(id_col).alias("rid"), counter(F.col(text_col)).alias("c")).select("rid", "c.*")
            .select("*", *[r.vote().alias(f"v_{r.name}") for r in rules]))
    rows = materialise(rows, "quality-votes")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = posterior(fit(rows, rules), rules)
    return (rows.withColumn("posterior", p).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
            .withColumnRenamed("rid", id_col))
