"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character 1-, 2- and 3-grams.
Every language has several centroids (spherical k-means inside the language);
a text gets the language of the centroid of highest cosine and is rejected
where even that one is farther than texts of its length ever are.
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
ORDERS = (1, 2, 3)
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams over lower-cased letters, where every run of
    other characters is one space; and the number of letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    n_letters = int(is_letter.sum())
    if not n_letters:
        return np.zeros(DIMS, np.float32), 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.where(is_letter, codes, 32)[keep].astype(np.uint64)
    c = np.concatenate([np.array([32], np.uint64), c, np.array([32], np.uint64)])
    counts = np.zeros(DIMS, np.int64)
    rolled = np.zeros(len(c), np.uint64)
    for order in ORDERS:
        m = len(c) - order + 1
        if m <= 0:
            break
        rolled = rolled[:m] * np.uint64(0x100000001B3) + c[order - 1:]
        mixed = (rolled + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return counts.astype(np.float32), n_letters


def _vectors(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF rows and letter counts."""
    rows, letters = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            rows[i], letters[i] = gram_counts(t)
    rows = np.log1p(rows) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norm, 1e-12), letters


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 15)


@dataclass
class Model:
    """langs[i] is the language of centroid row i; ``floors`` the least cosine
    accepted by length class."""
    idf: np.ndarray
    centroids: np.ndarray
    langs: list
    floors: np.ndarray


def _document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each hashed n-gram occurs, over all of them;
    every task sends one fixed-size vector."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                got, letters = gram_counts(t)
                if letters:
                    df[:DIMS] += got > 0
                    n += 1
        df[DIMS] = n
        yield pd.DataFrame({"i": np.arange(DIMS + 1), "n": df})

    rows = (training.select("text").mapInPandas(count, "i int, n long")
            .groupBy("i").agg(F.sum("n").alias("n")).collect())  # DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        df[r["i"]] = r["n"]
    return df[:DIMS], int(df[DIMS])


def _cluster(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start (deterministic)."""
    mean = x.sum(axis=0)
    seeds = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(seeds) < min(k, len(x)):
        best = np.max(x @ np.array(seeds).T, axis=1)
        seeds.append(x[int(best.argmin())])
    c = np.array(seeds)
    for _ in range(steps):
        at = (x @ c.T).argmax(axis=1)
        new = c.copy()
        for j in range(len(c)):
            if (at == j).any():
                s = x[at == j].sum(axis=0)
                new[j] = s / max(np.linalg.norm(s), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400,
          clusters: int = 4, slack: float = 0.6) -> Model | None:
    """Fit on rows with text and language.

    N-gram document frequencies cover all rows.  Centroids and length floors
    are fitted on at most ``per_lang`` distinct texts a language, those of
    lowest hash, so that a large group of copies counts as one text.  A floor
    is ``slack`` times the least own-language cosine seen in the length class
    or a longer one; below 128 letters, where a key or a number can be half
    the text, the slack shrinks with the length class.
    None when there is no usable row.
    """
    training = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    df, n = _document_frequencies(training)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    h = F.xxhash64("text")
    # copies collapse to their hash before the shuffle; one row a language comes back
    counts = training.select("lang", h.alias("h")).distinct().groupBy("lang").count().collect()
    wanted = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2.0 * per_lang / r["count"]))) for r in counts])
    near = (h.cast("double") / F.lit(2.0 ** 64) + 0.5) <= wanted  # twice the bound is expected to pass
    from pyspark.sql import Window
    sample = (training.filter(near).groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
              .filter(F.col("rank") <= per_lang).select("lang", "text"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, letters = _vectors(pdf["text"].tolist(), idf)
        x, letters = x[letters > 0], letters[letters > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroids": [], "least": []}, dtype=object)
        c = _cluster(x, clusters)
        sims, cls = (x @ c.T).max(axis=1), _length_class(letters)
        least = [float(sims[cls == j].min()) if (cls == j).any() else 2.0 for j in range(16)]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "least": [least]})

    rows = (sample.groupBy("lang").applyInPandas(fit, "lang string, centroids binary, least array<double>")
            .orderBy("lang").collect())  # `clusters` x DIMS floats a language
    if not rows:
        return None
    blocks = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in rows]
    least = np.min([r["least"] for r in rows], axis=0)
    floors = np.minimum.accumulate(least[::-1])[::-1].copy()  # a shorter class is never stricter
    floors[floors > 1] = 1.0
    return Model(idf, np.concatenate(blocks), [r["lang"] for r, b in zip(rows, blocks) for _ in b],
                 floors * slack * np.minimum(1.0, np.arange(16) / 7))


def predictor(model: Model | None):
    """Arrow-batched column function: text -> struct(lang, score, rejected)."""
    # one small fixed-size model travels with the tasks
    packed = None
    if model is not None:
        buf = io.BytesIO()
        np.savez_compressed(buf, idf=model.idf, c=model.centroids, floors=model.floors)
        packed = (buf.getvalue(), list(model.langs))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if packed is not None:
            z = np.load(io.BytesIO(packed[0]))
            idf, c, floors = z["idf"], z["c"], z["floors"]
            langs = np.array(packed[1], object)
        for texts in batches:
            texts = texts.tolist()
            lang = np.full(len(texts), UND, object)
            score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            for a in range(0, len(texts) if packed is not None else 0, 256):
                x, letters = _vectors(texts[a:a + 256], idf)
                sims = x @ c.T
                best = sims.argmax(axis=1)
                top = np.clip(sims[np.arange(len(x)), best].astype(np.float64), 0, 1)
                known = letters > 0
                lang[a:a + 256] = np.where(known, langs[best], UND)
                score[a:a + 256] = np.where(known, top, 0.0)
                rejected[a:a + 256] = ~known | (top < floors[_length_class(letters)])
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return F.pandas_udf(predict, "lang string, score double, rejected boolean").asNondeterministic()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds`` (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, **fit) -> DataFrame:
    """(id, held_out, lang, score, rejected) per row; trained on the rows that
    are not held out and whose id, text and language are known.

    A null text, or one without a letter, is ``und`` with score 0, rejected;
    so is every text when there is nothing to learn from.  Repeated rows and
    null ids each keep their row; an empty table gives no rows; language,
    source and id never enter a prediction.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds)), "text", "lang", **fit)
    p = predictor(model)(F.col("text"))
    return (rows.select(F.col(id_col), held_out(F.col(id_col), folds).alias("held_out"), p.alias("p"))
            .select(id_col, "held_out", "p.lang", "p.score", "p.rejected"))
