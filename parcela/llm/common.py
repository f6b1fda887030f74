"""What the operators of this subpackage share: tables, the shared folder, and word splitting.

A document is a row with ``doc_id`` and ``text``. Other columns are carried by the stages of the
pipeline and otherwise left alone. A null ``doc_id`` orders after every other one; a null text has no
words. Rows with equal ``doc_id`` are told apart by their text; rows equal in both get equal results.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcela.sources.tables import shared_dir

#: What separates words, as the inside of a regular expression's character class.
SPACE = r"\x20\x09-\x0D"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\f\r"
#: A null doc_id takes this place in the order of documents.
LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and a lost
    executor takes nothing with it. The table stays until discard() or until the shared folder is emptied."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() from which the next step was written: nothing will read them again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def order_id(doc_id: Column) -> Column:
    """doc_id as the place in the order of documents."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def text_key(text: Column) -> Column:
    """Tells rows with equal doc_id apart."""
    return F.xxhash64(text)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACE}]+")).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept while they are few enough to keep."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        return self.of_bytes((text or "").encode("utf-8", "surrogatepass"))

    def of_bytes(self, text: bytes) -> np.ndarray:
        """The hashes of the words of a text, which bytes.split() finds: it splits at SPACE only."""
        if len(self) > self.LIMIT:
            self.clear()
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """x (uint64) with its bits spread; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(tokens: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each run of n tokens (uint64); empty if there are fewer than n."""
    count = len(tokens) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    # runs of 1, 2, 4, ... tokens, joined where n has that bit: a + b tokens are one of a, shifted, and one of b
    base, power, size, done = np.uint64(seed | 1), tokens, 1, 0
    out = np.zeros(count, np.uint64)
    while size <= n:
        if n & size:
            out = out * np.uint64(pow(int(base), size, 1 << 64)) + power[done : done + count]
            done += size
        if 2 * size <= n:
            power = power[: len(power) - size] * np.uint64(pow(int(base), size, 1 << 64)) + power[size:]
        size *= 2
    return mixed(out)


def ranked(df: DataFrame, order: list[Column], name: str, parts: int | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """df, written, with `name`: places from 1 in an order, which should be total; and of each column of `before` the sum over
    the rows that come before. Ranges are sorted by themselves, and what the ranges before amount to is carried: a row a
    range, as many as shuffle partitions, comes to the driver."""
    parts, before = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), before or {}
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, name).withColumn("_range", F.shiftright("_at", 33))
    sums, carried = [0] + [0.0] * len(before), []
    for r in sorted(placed.groupBy("_range").agg(F.count("*"), *[F.sum(x).cast("double") for x in before.values()]).collect()):
        carried.append((r[0], *sums))
        sums = [a + (b or 0) for a, b in zip(sums, r[1:], strict=True)]
    carried = df.sparkSession.createDataFrame(carried, ", ".join(["_range long", "_before long", *(f"_sum{i} double" for i in range(len(before)))]))
    out = placed.join(F.broadcast(carried), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({n: F.col(f"_sum{i}") + F.coalesce(F.sum(x).over(within), F.lit(0.0)) for i, (n, x) in enumerate(before.items())})
    return out.drop("_range", "_at", "_before", *(f"_sum{i}" for i in range(len(before))))
