"""URL filter (DataFrame and ML pipeline operations only): curated rules, and
logistic regression on hashed character n-grams of host and path for the URLs
that no rule fits.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host and path): a rule fits its host and all subdomains where the
#: path starts with the rule's; the longest wins.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
#: Labelled URLs by hand (1 = block), beside the rule-labelled ones.
LABELLED = (
    ("https://casino-royal.example/slots/play", 1), ("http://win-casino.example/bonus", 1),
    ("https://best-bets.example/odds", 1), ("http://free-bets.example/join", 1),
    ("https://adult-cams.example/live", 1), ("http://x-adult.example/video/3", 1),
    ("https://cheap-pills.example/buy", 1), ("http://porn-tube.example/watch", 1),
    ("https://docs.python.example/library/json.html", 0), ("https://en.wiki.example/wiki/History", 0),
    ("https://news.example/world/article", 0), ("http://blog.example/posts/garden", 0),
    ("https://shop.example/cart", 0), ("https://school.example/course/maths", 0),
    ("https://m.weather.example/today", 0), ("https://library.example/catalogue", 0),
)
FEATURES = 1 << 14
#: Most rule-labelled URLs a model is fitted on.
FIT_ROWS = 5000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return (F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p),
                           F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _grams(text: Column, tag: str, sizes) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n):
        last = F.length(padded) - (n - 1)
        return F.when(last >= 1, F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.concat(F.lit(f"{tag}{n}"), F.substring(padded, i, F.lit(n)))
        )).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def features(df: DataFrame, sizes=(3, 4, 5)) -> DataFrame:
    """Adds hashed n-gram counts of host and path as ``features``."""
    grams = df.withColumn("grams", F.concat(_grams(F.col("host"), "h", sizes), _grams(F.col("path"), "p", sizes)))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def train(labelled: DataFrame, reg: float = 1e-3, steps: int = 40):
    """Model from rows (host, path, label); null when there are none."""
    rows = features(labelled.select("host", "path", F.col("label").cast("double").alias("label")))
    rows = rows.coalesce(4).cache()
    try:
        if rows.isEmpty():
            return None
        return LogisticRegression(maxIter=steps, regParam=reg, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def hand_labelled(spark: SparkSession) -> DataFrame:
    host, path = host_path(F.col("url"))
    return spark.createDataFrame(LABELLED, "url string, label int").select(host.alias("host"), path.alias("path"), "label")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict, else the
    model's; score is the model's probability of block.

    The model is fitted on the hand-labelled table (default ``LABELLED``) and
    at most ``fit_rows`` distinct rule-labelled URLs, those of lowest hash.
    Null, empty or scheme-less URLs have empty host and path and go to the
    model; repeated rows each keep their row; an empty table gives no rows;
    other columns are never read.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    rows = materialise(pages.select(F.col(id_col).alias("rid"), host.alias("host"), path.alias("path"))
                       .withColumn("by", rule_of(F.col("host"), F.col("path"), rules)), "url-rows")
    sample = (rows.filter(F.col("by").isNotNull())
              .select("host", "path", (F.col("by.verdict") == "block").cast("int").alias("label")).distinct()
              .orderBy(F.xxhash64("host", "path"), "host", "path").limit(fit_rows))
    model = train(materialise(sample.unionByName(hand_labelled(spark) if labelled is None else labelled), "url-labelled"))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        scored = (model.transform(features(rows))
                  .withColumn("score", vector_to_array("probability")[1]))
    return scored.select(
        F.col("rid").alias(id_col), "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce(F.col("by.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.col("score"))
