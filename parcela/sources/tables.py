"""Journals, snapshots, states and dead letters as files that Spark reads and writes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.sources import files

#: Folders of sessions on one machine that name no shared folder, by application.
OWN_DIRS: dict[str, str] = {}
FAILURES = "url string, page int, reason string, timestamp_utc timestamp"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only where driver and executors are one process
    a temporary folder serves instead."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or OWN_DIRS.get(context.applicationId)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="parcela-")
    return found


LOG = "_log"


def commits(spark: SparkSession, path: str) -> dict[int, str]:
    """The commits of a journal: their numbers, and what the names of their files end in."""
    return {int(n): files.read(spark, f"{path}/{LOG}/{n}") for n in files.names(spark, f"{path}/{LOG}") if n.isdigit()}


def journal_files(spark: SparkSession, path: str) -> list[str]:
    """What is to be read of a journal: the files of its commits, and those that came without one; of a
    commit that was begun and not logged, none."""
    if not files.exists(spark, f"{path}/{LOG}"):
        return [path]
    logged = commits(spark, path)
    plain = [f"{path}/{n}" for n in files.names(spark, path) if not n.startswith(("_", ".")) and not COMMITTED.match(n)]
    return plain + [f"{path}/part-{n:010d}-*-{own}.json" for n, own in sorted(logged.items())]


COMMITTED = re.compile(r"part-[0-9]{10}-[0-9]+-[0-9a-f]{32}\.json$")


def place_of_line() -> Column:
    """struct<commit, modified, file, block, line>, by which lines of a journal are in the order of their appends: by
    commit, then as the rows were. Files without a commit come first, by the time when they were written."""
    file = F.col("_metadata.file_name")
    commit = F.nullif(F.regexp_extract(file, r"^part-([0-9]{10})-[0-9]+-[0-9a-f]{32}\.json$", 1), F.lit("")).cast("long")
    modified = F.when(commit.isNull(), F.col("_metadata.file_modification_time"))
    return F.struct(commit.alias("commit"), modified.alias("modified"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_journal(spark: SparkSession, path: str, schema: str, offset: str | None = None) -> DataFrame:
    """The JSON lines that can be read; torn ones go. offset: a name for place_of_line(), by which the latest is found."""
    fields = T.StructType.fromDDL(schema).add("_torn", T.StringType())
    found = journal_files(spark, path)
    lines = spark.read.text(found) if found else spark.createDataFrame([], "value string")
    if offset:
        lines = lines.withColumn(offset, place_of_line()) if found else lines.withColumn(offset, F.lit(None))
    lines = lines.withColumn("value", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_torn"}))
    return lines.filter("value is not null and value._torn is null").select("value.*", *([offset] if offset else [])).drop("_torn")


def journal_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The distinct keys of a journal: no other field is read into rows."""
    return read_journal(spark, path, f"{key} string").filter(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def append_journal(rows: DataFrame, path: str) -> int:
    """rows as a commit of their own; returns its number. The files are written beside, named by the commit and in the order
    of rows, and count once the log names the commit: all of them or none. If another run takes the number, the next is tried."""
    spark, own = rows.sparkSession, uuid.uuid4().hex
    draft = f"{path}/_draft-{own}"
    rows.write.option("ignoreNullFields", "false").json(draft)
    parts = [f"{draft}/{n}" for n in files.names(spark, draft) if n.startswith("part-")]
    number = max(commits(spark, path), default=0) + 1
    if not parts:  # no rows: no commit
        files.delete(spark, draft)
        return number - 1
    while True:
        to = [f"{path}/part-{number:010d}-{i:06d}-{own}.json" for i in range(len(parts))]
        for a, b in zip(parts, to, strict=True):
            if not files.rename(spark, a, b):
                raise OSError(f"{b} can't be written")
        if files.publish(spark, f"{path}/{LOG}/{number:010d}", own):
            files.delete(spark, draft)
            return number
        parts, number = to, number + 1


def write_snapshot(rows: DataFrame, path: str, columns: list[str] | None = None, parts: int | None = None, excel: bool = False) -> None:
    """CSV with a header; doubled quotes; nulls and empty texts both as empty fields. As many files as there are partitions
    unless asked for a number. excel: each file begins with a byte-order mark, and lines end in CR LF, as spreadsheets
    want it. Written beside and then put in place: a run that ends before leaves the snapshot as it was."""
    rows = rows.select(*columns) if columns else rows
    rows = rows.coalesce(parts) if parts else rows
    if excel:
        first, *rest = rows.columns
        rows = rows.select(F.col(first).alias("\ufeff" + first), *rest)
    draft = f"{path}.draft-{uuid.uuid4().hex}"
    rows.write.options(header="true", escape='"', emptyValue="", nullValue="", lineSep="\r\n" if excel else "\n").csv(draft)
    files.replace(rows.sparkSession, draft, path)


def state(rows: DataFrame, key: str, page: str) -> DataFrame:
    """One row: the last page and the number of distinct keys."""
    return rows.agg(F.max(page).alias("last_page"), F.count_distinct(key).alias("unique_properties"))


def last_completed(pages: DataFrame, page: str, left: DataFrame, left_page: str) -> int | None:
    """The last of the pages before the first one of which rows are left to do: where the next run takes up."""
    first = left.agg(F.min(left_page)).first()[0]
    return pages.filter(F.lit(True) if first is None else F.col(page) < first).agg(F.max(page)).first()[0]


def failures(rows: DataFrame, reason: str, at: str) -> DataFrame:
    """FAILURES of rows (url, page) with a reason column and the time column at."""
    return rows.filter(F.col(reason).isNotNull()).select("url", F.col("page").cast("int").alias("page"), F.col(reason).alias("reason"), F.col(at).cast("timestamp").alias("timestamp_utc"))


def diagnostics(pages: DataFrame) -> DataFrame:
    """Pages that came back as intermediate (202), with the key that their dump is filed under."""
    return pages.filter("status = 202").select("url", "html", F.substring(F.sha1("url"), 1, 10).alias("key"))
