"""Snapshots by merge: the latest row of each key, in buckets by the key's hash, and manifests that say which files count.

A merge reads only the buckets that new rows fall into, writes those anew under the next version, and publishes a
manifest of all buckets in one rename. Until then, and if the run ends before, readers see the snapshot as it was. A
version's files are never changed; vacuum() deletes what no recent manifest names.

    path/v=7/bucket=3/part-*.parquet     path/_manifests/0000000007.json
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.operators.incremental import latest
from parcela.sources import files

BUCKETS = 64


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest one."""
    found = [n for n in files.names(spark, f"{path}/_manifests") if n.endswith(".json") and not n.startswith(".")]
    return json.loads(files.read(spark, f"{path}/_manifests/{found[-1]}")) if found else None


def stored(spark: SparkSession, path: str, now: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a manifest's buckets, of all or of some."""
    wanted = [b for b in map(str, buckets) if b in now["buckets"]] if buckets is not None else [*now["buckets"]]
    reader = spark.read.schema(now["schema"])
    paths = [f"{path}/v={now['buckets'][b]['version']}/bucket={b}" for b in wanted]
    return reader.parquet(*paths) if paths else spark.createDataFrame([], now["schema"])


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot as it is now: the columns of its rows, and first_seen. None if nothing was merged yet."""
    now = manifest(spark, path)
    return stored(spark, path, now) if now else None


def merge(rows: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS, batch: int | None = None) -> dict:
    """The snapshot with rows in it: of each key the row of the greatest order, and first_seen, the least order of any. Null
    keys are left out. batch: a number that grows; a batch that was merged already changes nothing. Returns the
    manifest. The number of buckets is that of the first merge. rows are read twice, and should be stored."""
    spark = rows.sparkSession
    now = manifest(spark, path)
    if now and batch is not None and now["batch"] is not None and batch <= now["batch"]:
        return now
    count = now["count"] if now else buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    new = latest(rows, key, order)
    touched = sorted(r[0] for r in rows.filter(F.col(key).isNotNull()).select(bucket).distinct().collect())  # at most `count`
    if now:
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], now["schema"]).schema])
    version = now["version"] + 1 if now else 1
    schema = now["schema"] if now else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    old = stored(spark, path, now, touched) if now else new.limit(0)
    both = old.unionByName(new)
    columns = [c for c in both.columns if c != "first_seen"]
    whole = F.max_by(F.struct(*columns), F.col(order)).alias("_row")
    merged = both.groupBy(key).agg(whole, F.min("first_seen").alias("first_seen")).select(*[F.col(f"_row.{c}").alias(c) for c in columns], "first_seen")
    # a version that was begun and not published is written over
    target = f"{path}/v={version}"
    merged.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    sizes = {r["bucket"]: r["n"] for r in spark.read.parquet(target).groupBy("bucket").agg(F.count("*").alias("n")).collect()} if touched else {}
    kept = dict(now["buckets"]) if now else {}
    kept |= {str(b): {"version": version, "rows": n} for b, n in sizes.items()}
    out = {"version": version, "key": key, "order": order, "count": count, "schema": schema, "batch": batch if batch is not None else (now or {}).get("batch"), "buckets": kept}
    if not files.publish(spark, f"{path}/_manifests/{version:010d}.json", json.dumps(out)):
        raise OSError(f"{path} was merged by another run at the same time")
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes the versions that none of the last `keep` manifests names, and older manifests; returns the versions."""
    found = [n for n in files.names(spark, f"{path}/_manifests") if n.endswith(".json") and not n.startswith(".")]
    wanted = {b["version"] for n in found[-keep:] for b in json.loads(files.read(spark, f"{path}/_manifests/{n}"))["buckets"].values()}
    newest = int(found[-1][:-5]) if found else 0
    gone = [v for v in (int(n[2:]) for n in files.names(spark, path) if n.startswith("v=")) if v not in wanted and v <= newest]
    for n in found[:-keep]:
        files.delete(spark, f"{path}/_manifests/{n}")
    for v in gone:
        files.delete(spark, f"{path}/v={v}")
    return gone


def export(spark: SparkSession, path: str, to: str, write) -> None:
    """The snapshot by another writer (rows, folder), whole and then put in the place of what was at `to`."""
    draft = f"{to}.draft-{uuid.uuid4().hex}"
    write(read(spark, path), draft)
    files.replace(spark, draft, to)
