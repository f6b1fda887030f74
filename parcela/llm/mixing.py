"""Mixing sources to target weights.

Sources take shares of all words by weight; no source may take more than CAP times what it has, and what a
capped source leaves over is shared again by weight until none is above its cap. A source's repetition rate
is target / size; each document is taken floor(rate) times, plus once more where a hash of the document,
seeded, falls below the fraction. So reruns agree, and equal rows are taken equally often.

A null source is a source of its own, last in order. A null text has no words. Sources without words have
target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import documents, materialize, n_words, ranked

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3.0, 20240611
#: Names that documents are unlikely to have: stages carry all their columns.
S = "_mix_"


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: source, size (one row a source). Adds weight (cyclic, in order of source by code point, null
    last) and target. One row a source stays distributed, in ranges; only sums of ranges come to the driver. Other columns of
    sizes are carried, but for those named weight, target, place, top, held and used."""
    cycle = F.array(*map(F.lit, weights))
    own = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    own = own.withColumn("weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))).drop("place")
    most = F.lit(cap) * F.col("size")
    total, all_weights = own.agg(F.sum("size"), F.sum("weight")).first()
    level = 0.0
    if total:
        # in order of the level (words for a unit of weight) at which sources reach their cap: those before hold their caps, the
        # others share the rest by weight; the first that this doesn't lift above its cap gives the level
        own = own.withColumn("top", most / F.col("weight"))
        own = ranked(own, [F.col("top"), F.col("source").asc_nulls_last()], "place", before={"held": most, "used": F.col("weight")})
        shared = (F.lit(float(total)) - F.col("held")) / (F.lit(float(all_weights)) - F.col("used"))
        level = own.filter(shared <= F.col("top")).agg(F.min_by(shared, "place")).first()[0]
        own = own.drop("top", "place", "held", "used")
    # written: Spark knows how small it is, and broadcasts it instead of dealing documents by their source
    return materialize(own.withColumn("target", F.least(most, F.lit(level) * F.col("weight")).cast("double")), "targets")


def uniform(seed: int, *columns: Column) -> Column:
    """In [0, 1), from the first 52 bits of a seeded MD5, which SQL engines have too."""
    whole = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_takes(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs with S + size, source_size, target and copies. Sources are matched by a broadcast where Spark
    finds their table small, and by a shuffle of documents otherwise."""
    sized = docs.withColumn(S + "size", n_words(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum(S + "size").alias("size"))
    targets = source_targets(sizes, weights, cap)
    targets = targets.select(F.col("source").alias(S + "source"), F.col("size").alias(S + "source_size"), F.col("target").alias(S + "target"))
    out = sized.join(targets, F.col("source").eqNullSafe(F.col(S + "source")), "left").drop(S + "source")
    rate = F.when(F.col(S + "source_size") > 0, F.least(F.lit(cap), F.col(S + "target") / F.col(S + "source_size"))).otherwise(0.0)
    draw = uniform(seed, F.col("doc_id"), F.col("text"))
    return out.withColumn(S + "copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns. docs must have doc_id, text and source; columns whose
    names begin with _mix_ are the operator's."""
    taken = with_takes(docs).filter(F.col(S + "copies") > 0)
    return taken.withColumn(S + "copy", F.explode(F.sequence(F.lit(1), F.col(S + "copies")))).select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    out = with_takes(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", F.col(S + "size").alias("size"), F.col(S + "source_size").alias("source_size"), F.col(S + "target").alias("target"), (F.col(S + "size") * F.col(S + "copies")).alias("taken"), F.col(S + "copies").alias("copies"))
