"""Small files and folders in any store that Spark reads: what journals and snapshots need to switch in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The store of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order; nothing if there is no such folder."""
    store, where = at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def read(spark: SparkSession, path: str) -> str:
    store, where = at(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """False if there is something at `to`."""
    store, where = at(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    return not store.exists(target) and store.rename(where, target)


def delete(spark: SparkSession, path: str) -> None:
    store, where = at(spark, path)
    store.delete(where, True)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that is there whole or not at all; False if there is one already."""
    store, where = at(spark, path)
    store.mkdirs(where.getParent())
    draft = f"{where.getParent()}/.draft-{uuid.uuid4().hex}"
    stream = store.create(spark._jvm.org.apache.hadoop.fs.Path(draft), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    done = rename(spark, draft, path)
    if not done:
        delete(spark, draft)
    return done


def replace(spark: SparkSession, draft: str, path: str) -> None:
    """The folder draft takes the place of path. What was there goes only once the new one is complete, and is found
    beside it, as path.old, if the run ends in between."""
    old = f"{path}.old"
    if exists(spark, path):
        delete(spark, old)
        rename(spark, path, old)
    if not rename(spark, draft, path):
        raise OSError(f"{path} was written by another run at the same time")
    delete(spark, old)
