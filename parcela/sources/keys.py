"""Known keys in buckets: a run's anti-join shuffles the new rows only, and never what is known.

The keys of all runs so far lie in a bucketed Parquet table in a folder of its own; new rows are dealt to the same buckets
and meet them without an exchange on the known side. A session that doesn't know the table yet is told of it by the
folder. Appends add one file a bucket; compact() makes one of all of a bucket's.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.sources import files

BUCKETS = 64


class KnownKeys:
    """Keys of one type. buckets and kind must be the same whenever the folder is opened. Null keys are never known."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.kind, self.buckets = spark, path, kind, buckets
        self.name = f"known_keys_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (known_key {kind}) USING parquet CLUSTERED BY (known_key) SORTED BY (known_key) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, key: str) -> None:
        """The distinct keys of rows that aren't known yet."""
        new = self.new_only(rows.select(key).filter(F.col(key).isNotNull()).distinct(), key)
        self.write(new.select(F.col(key).cast(self.kind).alias("known_key")), "append")

    def write(self, keys: DataFrame, mode: str) -> None:
        # a task a bucket: one file each
        out = keys.repartition(self.buckets, "known_key").write.mode(mode).format("parquet")
        out.bucketBy(self.buckets, "known_key").sortBy("known_key").option("path", self.path).saveAsTable(self.name)

    def new_only(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key isn't known, null keys among them."""
        # dealt as the table is: the table is neither shuffled nor broadcast
        dealt = rows.repartition(self.buckets, F.col(key).cast(self.kind))
        return dealt.join(self.table().hint("merge"), F.col(key).cast(self.kind) == F.col("known_key"), "left_anti")

    def compact(self) -> None:
        """One file a bucket. Written beside and put in place whole."""
        draft = f"{self.path}.draft-{uuid.uuid4().hex}"
        beside = KnownKeys(self.spark, draft, self.kind, self.buckets)
        beside.write(self.table().distinct(), "append")
        files.replace(self.spark, draft, self.path)
        self.spark.sql(f"DROP TABLE {beside.name}")
        self.spark.catalog.refreshTable(self.name)
