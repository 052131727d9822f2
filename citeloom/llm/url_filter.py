"""URL filter: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of n-grams, and cells they are hashed to.
GRAMS, CELLS = (3, 4, 5), 1 << 16
#: A URL with at least this probability is blocked.
BLOCK_FROM = 0.5
REGULARISATION = 0.001

# Rules (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# The labelled URL table is made of these words. Each unwanted pair is a blocked host
# name; every first with every second plain word is one that is not blocked.
UNWANTED = (
    ("cheap", "pills"), ("buy", "pills"), ("online", "pharmacy"), ("casino", "win"), ("casino", "bonus"), ("poker", "bonus"), ("free", "bets"), ("sports", "bets"),
    ("spam", "farm"), ("link", "farm"), ("ads", "track"), ("ads", "click"), ("click", "track"), ("adult", "x"), ("adult", "cams"), ("xxx", "cams"),
    ("payday", "loans"), ("replica", "watches"), ("win", "prizes"), ("free", "casino"),
)
PLAIN_FIRST = ("city", "daily", "garden", "open", "river", "the", "north", "stone", "other", "science", "weather", "music")
PLAIN_SECOND = ("library", "news", "notes", "lectures", "times", "station", "bridge", "archive", "council", "thinker", "letters", "school")
BEFORE = ("", "www.", "m.", "blog.")
ENDINGS = (("example.com", "/en/12"), ("example.net", "/de/3451.html"), ("example.org", "/fr/78/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host plus path, and its verdict; null where none fits."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in longest]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values)))
    return pick([h + p for h, p, _ in longest]), pick([v for *_, v in longest])


def labelled(spark: SparkSession) -> DataFrame:
    """``host, path, label`` (1: block), a small table made of the fixed words."""
    unwanted = [f"{a}-{b}" for a, b in UNWANTED]
    plain = [f"{a}{b}" if len(b) % 2 else f"{a}-{b}" for a, b in product(PLAIN_FIRST, PLAIN_SECOND)]
    rows = []
    for label, names in ((1.0, unwanted), (0.0, plain)):
        for n, name in enumerate(names):
            ending, path = ENDINGS[n % len(ENDINGS)]
            rows.append((f"{BEFORE[n % len(BEFORE)]}{name}.{ending}", path, label))
    return spark.createDataFrame(rows, "host string, path string, label double").coalesce(1)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked with where they come from; digits count as one."""

    def cut(text: Column, mark: str, n: int) -> Column:
        letters = F.filter(F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$")), ""), lambda c: c != "")
        starts = lambda all_: F.sequence(F.lit(0), F.greatest(F.size(all_) - n, F.lit(0)))
        joined = lambda all_: F.transform(starts(all_), lambda i: F.concat_ws("", F.lit(mark), *(F.get(all_, i + k) for k in range(n))))
        return F.flatten(F.transform(F.array(letters), joined))  # an array of one entry: the letters are made once

    return F.concat(*(cut(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS))


def _hashed(rows: DataFrame) -> DataFrame:
    tf = HashingTF(numFeatures=CELLS, binary=True, inputCol="_grams", outputCol="_features")
    return tf.transform(rows.withColumn("_grams", grams(F.col("host"), F.col("path"))))


def train(rows: DataFrame) -> LogisticRegressionModel:
    """A model from ``host, path, label``; the table is meant to be small."""
    lr = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", regParam=REGULARISATION, maxIter=50)
    return lr.fit(_hashed(rows))


def judged(pages: DataFrame, model: LogisticRegressionModel | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages`` (page_id, url).

    The longest rule that fits decides, else the model: block from ``BLOCK_FROM``. score is the
    model's probability of block, also where a rule decides. A null URL or one without ``://``
    has an empty host and path and is judged by the model like any other. Repeated rows give
    repeated rows; other columns are not looked at; no rows give no rows.
    """
    model = model or train(labelled(pages.sparkSession))
    host, path = parts(F.col("url"))
    rows = _hashed(pages.select(F.col("page_id"), host.alias("host"), path.alias("path")))
    score = vector_to_array(F.col("_probability"))[1]
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    scored = model.transform(rows).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_by_rule"), score.alias("score"))
    by_model = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_model).alias("verdict"), "score")
