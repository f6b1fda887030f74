"""Counters of what flows through a run, taken while it is written: no second pass over any table.

    counters = Counters(spark)
    counters.watch(rows, "rows", n_priced=F.count("precio")).write.parquet(...)
    counters.found  # {"rows": {"n_rows": ..., "n_priced": ...}}

The metrics are aggregates of a row group each, without distinct ones: numbers of keys are the rows that are left of each
key. ProgressTable keeps what a stream observes, a line for each micro-batch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from parcela.sources import files


class Counters:
    def __init__(self, spark: SparkSession):
        self.spark, self.watched = spark, {}

    def watch(self, rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """rows, to be written once; n_rows and the metrics are known afterwards."""
        self.watched[name] = Observation(name)
        return rows.observe(self.watched[name], F.count(F.lit(1)).alias("n_rows"), *[m.alias(n) for n, m in metrics.items()])

    @property
    def found(self) -> dict[str, dict]:
        """Waits for what was watched and not yet written."""
        return {name: dict(o.get) for name, o in self.watched.items()}

    def save(self, path: str) -> None:
        """A line for each name."""
        rows = [(n, json.dumps(m, sort_keys=True, default=str)) for n, m in self.found.items()]
        self.spark.createDataFrame(rows, "name string, metrics string").coalesce(1).write.mode("overwrite").json(path)


class ProgressTable(StreamingQueryListener):
    """Writes a file for each micro-batch of the session's streams that has rows: the stream, the batch, rows read and what was observed."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        line = {"query": str(p.id), "run": str(p.runId), "batch": p.batchId, "n_input": p.numInputRows, "observed": {n: r.asDict() for n, r in p.observedMetrics.items()}}
        if p.numInputRows:
            files.publish(self.spark, f"{self.path}/{p.runId}-{p.batchId:010d}.json", json.dumps(line, default=str))
