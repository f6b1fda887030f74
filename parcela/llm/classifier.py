"""Quality classifier: a weak-label model, then a hashed linear scorer.

Heuristic labellers, which overlap, vote good, bad or very bad on each document or abstain; expectation-maximisation
estimates their accuracies from the vote patterns of all documents (quality.fit_labels). The posterior
labels train a logistic regression on hashed features of the text's word shapes, their neighbours and
repetitions, on at most SAMPLE documents chosen by a hash (each with both labels, weighted by its
posterior). The scorer then judges every document. Votes and features are worked out once and written.

A null text is an empty one; a text without words has no features and gets score 0 and kept false. Equal texts
get equal scores, so repeated rows and ties need no care. A table without any words, or without rows, is judged
without fitting. score and kept replace columns of the caller's of those names; those whose names begin with _qc_ are the
operator's; others are carried.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import SPACE, SPACE_CHARS, documents, materialize
from parcela.llm.quality import LabelModel, count_of, fit_labels

#: The most documents that the scorer is fitted on, and the number of hashed features.
SAMPLE, DIMENSIONS = 12_000, 1 << 13
C = "_qc_"


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the words' shapes and the votes."""
    c = lambda name: F.col(C + name)
    at = lambda a, i: F.get(a, i)
    df = df.withColumn(C + "t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(C + "w", F.filter(F.split(c("t"), rf"[{SPACE}]+"), lambda w: w != ""))
    df = df.withColumn(C + "n", F.size(c("w")).cast("double"))
    df = df.withColumn(C + "same", F.size(F.filter(c("w"), lambda w, i: (i > 0) & (w == at(c("w"), i - 1)))).cast("double"))
    df = df.withColumn(C + "distinct", F.size(F.array_distinct(c("w"))).cast("double"))
    # letters of one case become one letter, digits one digit; marks stay
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("t"), r"[\p{Ll}\p{Lo}]+", "a"), r"\p{Lu}{2,}", "AA"), r"\p{N}+", "0")
    df = df.withColumn(C + "shapes", F.filter(F.split(shape, rf"[{SPACE}]+"), lambda w: w != ""))
    low_is_good = lambda x, good, bad, worst: F.when(x <= good, 1).when(x > worst, -2).when(x > bad, -1).otherwise(0)
    n = F.greatest(c("n"), F.lit(1.0))
    letters = F.greatest(F.length(F.regexp_replace(c("t"), r"[^\p{L}]", "")), F.lit(1)).cast("double")
    upper = F.length(F.regexp_replace(c("t"), r"[^\p{Lu}]", "")).cast("double")
    votes = {
        "marks": low_is_good(count_of(c("t"), "#*$%&<>|") / n, 0.02, 0.15, 0.30),
        "upper": low_is_good(upper / letters, 0.10, 0.50, 0.70),
        "shouts": low_is_good(count_of(c("t"), "!") / n, 0.03, 0.25, 0.50),
        "same_word": low_is_good(c("same") / n, 0.04, 0.20, 0.40),
        "variety": F.when(c("n") < 30, 0).otherwise(low_is_good(1 - c("distinct") / n, 0.70, 0.90, 0.95)),
        "length": F.when(c("n") >= 50, 1).when(c("n") < 1, -1).otherwise(0),
        "letters": low_is_good(1 - letters / F.greatest(F.length(F.translate(c("t"), SPACE_CHARS, "")).cast("double"), F.lit(1.0)), 0.20, 0.50, 0.70),
    }
    return df.withColumns({C + "v_" + k: v for k, v in votes.items()})


VOTES = ("marks", "upper", "shouts", "same_word", "variety", "length", "letters")


def features(df: DataFrame) -> DataFrame:
    """df with C + 'x': the hashed shapes, pairs of shapes and repetitions, as shares."""
    c = lambda name: F.col(C + name)
    pairs = F.transform(c("shapes"), lambda w, i: F.concat(F.coalesce(F.get(c("shapes"), i - 1), F.lit("^")), F.lit(" "), w))
    again = F.transform(c("w"), lambda w, i: F.when((i > 0) & (w == F.get(c("w"), i - 1)), "=again").otherwise("=new"))
    df = df.withColumn(C + "tokens", F.concat(c("shapes"), pairs, again))
    df = HashingTF(numFeatures=DIMENSIONS, inputCol=C + "tokens", outputCol=C + "tf").transform(df)
    return Normalizer(p=2.0, inputCol=C + "tf", outputCol=C + "x").transform(df)


def written(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """columns of docs with C + 'n' (words), C + 'key' (a hash of the text), votes and features: one pass over the texts."""
    key = F.xxhash64(F.lit(20240611), F.col(text)).alias(C + "key")
    return materialize(features(prepared(docs, text)).select(*columns, C + "n", key, *[C + "v_" + k for k in VOTES], C + "x"), "features")


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, object]:
    return fit_written(written(docs, [], text), sample)


def fit_written(known: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, object]:
    """The label model of all documents, and the scorer; None for it where no document has a word."""
    names = [C + "v_" + k for k in VOTES]
    own = known.filter(F.col(C + "n") > 0)
    labels, n = fit_labels(own, names), own.count()
    if not n:
        return labels, None
    share = min(1.0, 0.9 * sample / n)
    chosen = own.filter(F.shiftrightunsigned(C + "key", 11).cast("double") / float(1 << 53) < share).dropDuplicates([C + "key"])
    p = labels.posterior({x: F.col(x) for x in names})
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col(C + "p").alias("k")), F.struct(F.lit(0.0).alias("y"), (1 - F.col(C + "p")).alias("k"))))
    rows = chosen.withColumn(C + "p", p).select(C + "x", both.alias("label")).select(C + "x", "label.*")
    model = LogisticRegression(featuresCol=C + "x", labelCol="y", weightCol="k", probabilityCol=C + "prob", rawPredictionCol=C + "raw", predictionCol=C + "y", maxIter=40, regParam=1e-3).fit(rows)
    return labels, model


def scored(docs: DataFrame, model, text: str = "text", keep: float = 0.5) -> DataFrame:
    """docs with score, the probability that the text is good, and kept."""
    return scored_written(features(prepared(docs, text)), docs.columns, model, keep)


def scored_written(known: DataFrame, columns: list[str], model, keep: float = 0.5) -> DataFrame:
    out = model.transform(known).withColumn(C + "score", F.get(vector_to_array(C + "prob"), F.lit(1))) if model else known.withColumn(C + "score", F.lit(0.0))
    score = F.when(F.col(C + "n") > 0, F.col(C + "score")).otherwise(0.0)
    return out.select(*[c for c in columns if c not in ("score", "kept")], score.alias("score"), (score >= keep).alias("kept"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, score and kept of every document."""
    known = written(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    _, model = fit_written(known)
    return scored_written(known, ["doc_id"], model).withColumn("score", F.round("score", 6))
