"""The crawl loop as a stream: files of captured rows in, first-wins journal and latest-wins snapshot out.

Each micro-batch is one file (a results page) unless told otherwise; the checkpoint remembers what was read and
which keys were seen, so that a run can be stopped and taken up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcela.operators.incremental import latest
from parcela.sources import files, snapshots, tables


def captured_rows(spark: SparkSession, path: str, schema: str, files: int = 1, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def first_wins(rows: DataFrame, key: str, late: str | None = None, column: str | None = None) -> DataFrame:
    """Rows whose key wasn't seen before, in this run or an earlier one. With an event-time column and a bound
    on lateness, state is dropped behind the watermark."""
    if late and column:
        return rows.withWatermark(column, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def write_journal(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet journal what there is, then ends."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dead_letters(rows: DataFrame, reason: str, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch split: rows without a reason to one table, the others to the dead letters."""

    def split(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder: no row is written twice
        batch.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(journal: DataFrame, key: str, order: str) -> DataFrame:
    return latest(journal, key, order)


def with_snapshots(rows: DataFrame, key: str, order: str, path: str, checkpoint: str, every: int = 1, csv: bool = True) -> StreamingQuery:
    """Each micro-batch to a journal under path; after every so many of them what came since is merged into the snapshot (latest
    of each key, parcela.sources.snapshots) under path/table: of the journal only new batches are read, of the
    snapshot only the buckets that they touch. csv: the snapshot and the state are exported then, too. A batch that is run
    again overwrites its own folder, and is merged once."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/journal/batch={number}")
        if number % every == 0:
            merge_new(batch.sparkSession, key, order, path)
            if csv:
                export(batch.sparkSession, order, path)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_new(spark: SparkSession, key: str, order: str, path: str) -> dict | None:
    """The batches of the journal under path that the snapshot hasn't yet, merged into it."""
    now = snapshots.manifest(spark, f"{path}/table")
    done = -1 if now is None or now["batch"] is None else now["batch"]
    new = sorted(n for n in (int(x.partition("=")[2]) for x in files.names(spark, f"{path}/journal") if x.startswith("batch=")) if n > done)
    if not new:
        return now
    return snapshots.merge(spark.read.parquet(*[f"{path}/journal/batch={n}" for n in new]), f"{path}/table", key, order, batch=new[-1])


def export(spark: SparkSession, order: str, path: str) -> None:
    whole = snapshots.read(spark, f"{path}/table")
    if whole is not None:
        tables.write_snapshot(whole, f"{path}/snapshot")
        state = whole.agg(F.max(order).alias("last"), F.count("*").alias("n_keys"))
        draft = f"{path}/state.draft"
        state.write.mode("overwrite").json(draft)
        files.replace(spark, draft, f"{path}/state")


def write_state(spark: SparkSession, key: str, order: str, path: str) -> None:
    """The snapshot and the state of the journal under path; to be called at the end of a run."""
    merge_new(spark, key, order, path)
    export(spark, order, path)
