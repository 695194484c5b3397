import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from llm_paths import CLASH  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from metaprism.session import get_spark
    return get_spark(master="local[4]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts, languages and sources, empty and long texts, repeated
    rows, and extra columns that clash with names the operators use."""
    long = "alpha beta gamma " * 20_000 + 'token = "0123456789abcdef01234567" mail a@b.example.com'
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, None, "en", "a"), (3, "", "fr", None), (4, " \n\t ", None, "b"), (None, "a null id with some text", "en", "b"),
        (None, None, None, None), (5, long, "en", "a"), (6, "the quick brown fox jumps over the lazy dog again and again", "en", "c"),
        (7, "repeated row here for the test of rows", "de", "b"), (7, "repeated row here for the test of rows", "de", "b"),
        (7, "another text under the same id", "de", "b"), (8, "1234 5678 \U0001F600 ### $$$", "es", "c"), (9, "x", "es", "c"),
    ]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [(1, "http://A.Example.com/en/1?x#y", "<p>one"), (2, None, None), (3, "", ""), (4, "no scheme", "<p>one"),
            (None, "https://net/es/", "<p>one"), (5, "x://www.example.com/en/?", "<table><td>a" * 50), (6, "http://q.net/fr/z", "p" * 300_000),
            (7, "http://h", "<p>dup"), (7, "http://h", "<p>dup"), (None, None, "only null id"), (None, None, "only null id")]
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in CLASH])
