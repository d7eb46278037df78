"""URL verdicts: rules on host and path first, else a logistic regression.

The model reads hashed character n-grams of host and path and is trained from a
small labelled URL table.  All columns are Spark expressions and ML transformers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, path, verdict

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17

# The labelled URL table: names of sites to block and to allow, each under the common shapes of a url, so that a shape says nothing.
BLOCKED = """casino-win casino-bonus royal-casino win-casino online-casino mega-casino-win casino-slots poker-win live-casino
    cheap-pills pills-cheap buy-pills diet-pills cheap-meds pills-online viagra-pills free-bets bets-free live-bets daily-bets
    free-bet-tips sports-bets best-bets adult-x adult-cams xxx-adult adult-dating hot-adult adult-video free-adult spam-farm
    link-farm spam-links seo-spam spam-site content-farm farm-spam ads-track ad-tracker track-ads click-ads ads-click
    ads-serve banner-ads payday-loans quick-loans replica-watches get-rich-now super-bets super-pills cheap-pills-now mega-cheap-pills
    ad-tracking tracking-pixel ads-tracker click-tracking""".split()
ALLOWED = """city-post library university museum project school-board recipes garden weather travel-notes history science music
    books council hospital wiki cooking open-source linguistics bank transport sport-club theatre forum railway shop gallery
    stationery thering tionsh therin thther tiontion erand onener ththre ththan therat ened theas ingness reation ththly theres
    anter athle hender standing tionble atonen therhe ththin book-club town-hall art-school night-sky free-library film-review
    old-maps bird-watch green-energy river-walk clown-fish orchard orchids newsroom daily-news""".split()
SHAPES = ("http://{}.example.com/en/12", "https://www.{}.example.org/de/7.html", "http://m.{}.test/fr/340/",
          "https://{}.example.net/es/901", "http://blog.{}.example.com/en/55.html?page=2", "http://{}.test/",
          "http://www.{}.example.com/de/88", "https://m.{}.example.org/en/6", "http://blog.{}.example.net/es/4")
LABELLED = [(shape.format(name), label) for names, label in ((BLOCKED, 1), (ALLOWED, 0)) for name in names for shape in SHAPES]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(text: Column) -> Column:
    """All character n-grams, with marks at both ends."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.flatten(F.array(*[
        F.when(F.length(marked) >= n, F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i, n=n: F.substring(marked, i, n)))
        .otherwise(F.array().cast("array<string>")) for n in GRAMS]))


def _features(df: DataFrame) -> DataFrame:
    """Digits are one sign: the numbers in paths say nothing.  The top-level domain is left to the rules."""
    host = F.regexp_replace("host", r"\.[^.]*$", "")
    text = F.regexp_replace(F.concat(host, F.lit("|"), F.col("path")), "[0-9]+", "0")
    return df.withColumn("_grams", grams(text))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED) -> PipelineModel:
    rows = [(u, float(y)) for u, y in labelled]
    table = spark.createDataFrame(rows, "url string, label double").coalesce(1)
    table = _features(table.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features")
    regression = LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.002, maxIter=40,
                                    probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted")
    return Pipeline(stages=[hashed, regression]).fit(table)


def fits(rule: Rule) -> Column:
    host, path, _ = rule
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))


def judge(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score``: ``allow`` or ``block`` for every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
    Without a rule the model's score, from 0.5 on, blocks.  A url that is null or has no ``://`` has an empty host and
    path and is allowed: there is nothing to go by.  Repeated rows are judged alike; other columns are left out.
    """
    parsed = pages.select("page_id", "url", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        rule = F.when(fits(r), F.lit(r[0] + r[1])).otherwise(rule)
        verdict = F.when(fits(r), F.lit(r[2])).otherwise(verdict)
    scored = model.transform(_features(parsed.withColumn("rule", rule).withColumn("_verdict", verdict)))
    score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(vector_to_array("_probability")[1])
    own = F.when(F.col("_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("_score", score).select(
        "page_id", "url", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), F.col("_score").alias("score"))
