"""Files in the shared folder: small marks beside tables, and what a table's files are."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def read_mark(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none. Any other error is raised."""
    files, at = _path(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_mark(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a small file as a whole; without ``replace`` only if there is none yet. Whether it was written.

    The text is written beside it and renamed, so no reader sees half of it; a
    rename onto an existing file is refused, which makes the file a claim that
    one of several writers gets.
    """
    files, at = _path(spark, path)
    _, beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if replace and files.exists(at):
        files.delete(at, False)
    won = not files.exists(at) and files.rename(beside, at)
    if not won:
        files.delete(beside, False)
    return won


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time) of the files that a table is read from; one listing for each folder, no file is opened."""
    spark = df.sparkSession
    paths = df.inputFiles()
    wanted, found = set(paths), []
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        files, at = _path(spark, folder)
        for status in files.listStatus(at):
            name = status.getPath().toUri().toString()
            if name in wanted or name.replace("file:/", "file:///", 1) in wanted:
                found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def fingerprint_of(df: DataFrame, *more: str) -> str | None:
    """A mark of the files that a table is read from and of ``more``; None where it isn't read from files."""
    try:
        found = files_of(df)
    except PySparkException:
        return None
    if not found:
        return None
    return hashlib.sha256(repr((found, more)).encode()).hexdigest()[:32]
