"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

Everything is DataFrame functions and the DataFrame-based spark.ml. The model is trained from a small table of
labelled urls (url, label; 1: unwanted): the caller's, or labelled_urls(), which reads the one beside this file.

A null url, or one without ://, has empty host and path and no rule; the model judges the empty string.
Equal urls get equal verdicts, so repeated rows and ties need no care; an empty table gives an empty result. judged()
gives its answers as a struct column, so that columns of the caller's of any other name stay as they are, but for those whose
names begin with _url_, which are the operator's.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMENSIONS, GRAMS = 1 << 14, (3, 4, 5)


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end; ASCII letters in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null if none does."""
    names, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        names, verdicts = F.when(fits, F.lit(h + p)).otherwise(names), F.when(fits, F.lit(verdict)).otherwise(verdicts)
    return names, verdicts


def grams(text: Column, kind: str, sizes=GRAMS) -> Column:
    """The character n-grams of the text between marks, each with its kind in front."""
    full = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(full) - (n - 1))
        return F.when(F.length(full) >= n, F.transform(places, lambda i: F.concat(F.lit(kind), F.substring(full, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: unwanted): the table beside this file, which the driver reads."""
    with (Path(__file__).parent / "labelled_urls.csv").open(encoding="utf-8", newline="") as file:
        rows = [(r["url"], float(r["label"])) for r in csv.DictReader(file)]
    return spark.createDataFrame(rows, "url string, label double")


U = "_url_"


def features(df: DataFrame, url: str) -> DataFrame:
    """df with the hashed n-grams of host and path, in the column U + 'x'."""
    df = df.withColumn(U + "grams", F.concat(grams(host(F.col(url)), "h"), grams(path(F.col(url)), "p")))
    return HashingTF(numFeatures=DIMENSIONS, inputCol=U + "grams", outputCol=U + "x", binary=True).transform(df).drop(U + "grams")


def fit(labelled: DataFrame, steps: int = 40, penalty: float = 0.02):
    """A logistic regression on labelled (url, label)."""
    return LogisticRegression(featuresCol=U + "x", labelCol="label", probabilityCol=U + "p", rawPredictionCol=U + "raw", predictionCol=U + "y", maxIter=steps, regParam=penalty).fit(features(labelled.select("url", "label"), "url"))


JUDGED = ("host", "path", "rule", "verdict", "p_unwanted")


def judged(df: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES, block_from: float = 0.5, out: str = "judged") -> DataFrame:
    """df with the column out (which replaces one of that name): a struct of JUDGED. p_unwanted is the model's
    probability that the url is unwanted."""
    kept = [c for c in df.columns if c != out]
    scored = fit(labelled).transform(features(df.withColumn(U + "url", F.col(url)), U + "url"))
    scored = scored.withColumns({U + "host": host(F.col(U + "url")), U + "path": path(F.col(U + "url")), U + "unwanted": F.get(vector_to_array(U + "p"), F.lit(1))})
    name, verdict = rule(F.col(U + "host"), F.col(U + "path"), rules)
    own = F.when(F.col(U + "unwanted") >= block_from, "block").otherwise("allow")
    values = (F.col(U + "host"), F.col(U + "path"), name, F.coalesce(verdict, own), F.col(U + "unwanted"))
    return scored.select(*kept, F.struct(*[v.alias(k) for k, v in zip(JUDGED, values, strict=True)]).alias(out))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and p_unwanted of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judged(pages, labelled_urls(spark)).select("page_id", "judged.*")
    return out.withColumn("p_unwanted", F.round("p_unwanted", 6))
