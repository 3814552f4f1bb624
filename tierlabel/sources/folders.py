"""Small files and listings of shared folders, by the file systems that Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it."""
    target, system = _open(spark, path)
    return system.makeQualified(target).toString()


def kept_until_the_end(spark: SparkSession, path: str) -> str:
    """Make a folder that goes when the application ends; its path with its file system."""
    target, system = _open(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return qualified(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    target, system = _open(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _open(spark, path)
    return system.exists(target)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, sorted; none if it is not there."""
    target, system = _open(spark, path)
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark has marked a written table as complete."""
    return exists(spark, f"{path}/_SUCCESS")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it, so that nobody reads half of it."""
    draft, system = _open(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise FileExistsError(f"{path} is there already")


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _open(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
