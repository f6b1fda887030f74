"""Importance resampling towards a target distribution, over hashed features.

Features are runs of 1 to `n` words; each has a bucket, crc32 modulo `buckets`. Documents become inverted postings:
a row for each bucket and block of documents, with the documents' places in the block and their counts. Postings are
shuffled by bucket and meet the bucket's counts in both corpora there; the gain of the bucket is computed where they
meet, and contributions (count times gain) go back to the block, where they are added up by document. A bucket of very
frequent words has as many rows as there are blocks, which Spark can split; a block's documents are bounded, and
so is what a document's sum is made of. Corpora's counts are one row a bucket.

A document's weight is the floored mean of the gains of its features, and 0 without any. Weight plus Gumbel noise, seeded by the
document's id, is its score; of the documents with enough words the highest scores are drawn, which is a draw without
replacement in proportion to exp(weight / 1000). Ties go to the smaller id.

A null text has no words. A null id is hashed as an empty string and orders after all others. Rows with equal ids are
documents of their own, with equal noise; repeated rows are repeated. Empty tables (of documents, of the target or both) give
no rows, or gains of counts that are 0. docs must have doc_id and text, target must have text; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import discard, documents, materialize, ranked

GRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: What separates words becomes a space, A-Z become a-z; all bytes from 0x80 on are parts of words.
FOLDED = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of text and documents of a block at most (one document may have more bytes); features kept by a task;
#: documents whose sums a task holds before it gives them back.
BLOCK_BYTES, BLOCK_DOCS, KEPT_FEATURES, HELD = 4 << 20, 1 << 14, 1_000_000, 1 << 21
#: docs and counts (of bucket -1: n_features and n_words): little-endian 32-bit integers.
POSTINGS = "block long, bucket int, total long, docs binary, counts binary, words binary, ids array<bigint>"
POSTINGS_TYPE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("total", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("ids", pa.list_(pa.int64()))])
SUMS_TYPE = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary())])
WEIGHTS = "doc_id long, n_features long, n_words long, weight long"


class Buckets(dict):
    """Buckets of features (bytes), kept while they are few enough to keep."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = value = crc32(feature) % self.buckets
        return value

    def of(self, words: list[bytes], n: int) -> np.ndarray:
        if len(self) > KEPT_FEATURES:
            self.clear()
        grams = [words, *([b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, n + 1))]
        return np.concatenate([np.fromiter(map(self.__getitem__, g), np.int32, len(g)) for g in grams])


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of so many rows at a time as make a block."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py() or b"")
        size += len(texts[-1])
        if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def postings(docs: DataFrame, n: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """POSTINGS of docs (doc_id, text): a row for each block and bucket, and one with bucket -1 of the documents."""

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = Buckets(buckets), TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in blocks(batch):
                words = [t.translate(FOLDED).split() for t in texts]
                found = [known.of(w, n) for w in words]
                features, n_words = np.array([len(x) for x in found], "<i4"), np.array([len(w) for w in words], "<i4")
                doc = np.repeat(np.arange(len(ids), dtype=np.int64), features)
                key, count = np.unique(np.concatenate(found).astype(np.int64) * len(ids) + doc, return_counts=True)
                bucket, doc, count = key // len(ids), (key % len(ids)).astype("<i4"), count.astype("<i4")
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
                total = np.add.reduceat(count.astype(np.int64), first) if len(first) else first
                ends = [*first[1:], len(bucket)]
                split = lambda x: [x[a:b].tobytes() for a, b in zip(first, ends, strict=False)]
                k = len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * (k + 1), pa.int64()), pa.array(np.r_[bucket[first], -1].astype(np.int32)), pa.array(np.r_[total, features.sum()].astype(np.int64)),
                    pa.array([*split(doc), b""], pa.binary()), pa.array([*split(count), features.tobytes()], pa.binary()),
                    pa.array([None] * k + [n_words.tobytes()], pa.binary()), pa.array([None] * k + [ids], pa.list_(pa.int64())),
                ], schema=POSTINGS_TYPE)
                block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(inverted, POSTINGS)


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, of POSTINGS of both corpora: a row for each bucket that either has."""
    sums = own.filter("bucket >= 0").groupBy("bucket").agg(F.sum("total").alias("s"))
    wanted = target.filter("bucket >= 0").groupBy("bucket").agg(F.sum("total").alias("t"))
    both = sums.join(wanted, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both = materialize(both, "bucket-counts")  # a row a bucket
    s_all, t_all = (x or 0 for x in both.agg(F.sum("s"), F.sum("t")).first())
    up, down = (F.col("t") + 1).cast("double") * float(s_all + buckets), (F.col("s") + 1).cast("double") * float(t_all + buckets)
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def contributions(own: DataFrame, of_buckets: DataFrame) -> DataFrame:
    """block, docs and sums (64-bit) of each task's share of the buckets. The join is by shuffle: postings lie by bucket."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for block, parts in held.items():
                doc, inverse = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
                total = np.zeros(len(doc), np.int64)
                np.add.at(total, inverse, np.concatenate([v for _, v in parts]))
                rows.append((block, doc.astype("<i4").tobytes(), total.astype("<i8").tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SUMS_TYPE.types, strict=True)], schema=SUMS_TYPE)

        for batch in batches:
            for block, docs, counts, gain in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                doc = np.frombuffer(docs, "<i4")
                held.setdefault(block, []).append((doc, np.frombuffer(counts, "<i4") * np.int64(gain)))
                size += len(doc)
            if size > HELD:
                yield out()
                size = 0
        if held:
            yield out()

    met = own.filter("bucket >= 0").select("bucket", "block", "docs", "counts").hint("merge").join(of_buckets, "bucket")
    return met.select("block", "docs", "counts", "gain").mapInArrow(added, "block long, docs binary, sums binary")


def weights(docs: DataFrame, target: DataFrame, n: int = GRAM, buckets: int = BUCKETS) -> DataFrame:
    """WEIGHTS of docs, a row for each row."""
    own = materialize(postings(docs, n, buckets), "postings")
    wanted = materialize(postings(target.select(F.lit(None).alias("doc_id"), "text"), n, buckets), "target-postings")
    sums = contributions(own, gains(own, wanted, buckets))
    told = own.filter("bucket = -1").select("block", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("sums"), "counts", "words", "ids")
    every = sums.select("block", "docs", "sums", *(F.lit(None).cast(t).alias(c) for c, t in (("counts", "binary"), ("words", "binary"), ("ids", "array<bigint>")))).unionAll(told)

    def reduced(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        doc = next(r for r in rows if r["ids"] is not None)
        features, n_words = np.frombuffer(doc["counts"], "<i4").astype(np.int64), np.frombuffer(doc["words"], "<i4").astype(np.int64)
        total = np.zeros(len(features), np.int64)
        for r in rows:
            if r["ids"] is None:
                total[np.frombuffer(r["docs"], "<i4")] += np.frombuffer(r["sums"], "<i8")
        return pa.table([pa.array(doc["ids"], pa.int64()), pa.array(features), pa.array(n_words), pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_features", "n_words", "weight"])

    out = materialize(every.groupBy("block").applyInArrow(reduced, WEIGHTS), "weights")
    discard(own, wanted)
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """-1000 ln(-ln u), u in (0, 1) from the first 32 bits of a seeded SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.lit(-1000.0) * F.log(-F.log((h + 0.5) / float(1 << 32)))


def resample(docs: DataFrame, target: DataFrame, n: int = GRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """WEIGHTS of every row of docs with score and rank, which is null where a document isn't drawn."""
    scored = weights(docs, target, n, buckets).withColumn("score", (F.col("weight") + F.floor(noise(F.col("doc_id"), seed))).cast("long"))
    fit = F.col("n_words") >= least_words
    drawn = math.floor(percent * scored.filter(fit).count() / 100)
    first = ranked(scored.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, resampled towards the benchmark's texts."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")
