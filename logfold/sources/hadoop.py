"""The few file operations that need a commit point, through the session's Hadoop file systems."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Makes a file that must not exist, whole or not at all; False if it exists.

    The bytes are written under a name of their own first. A hard link on a local file system and a rename without
    overwrite on HDFS then either give them the path or fail; an object store needs a conditional put in their place."""
    fs, p = _at(spark, path)
    jvm = spark.sparkContext._jvm
    if fs.exists(p):
        return False
    own = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.part")
    out = fs.create(own, False)
    try:
        out.write(data)
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(own.toUri().getPath(), p.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, p, options)
    except Exception:
        if fs.exists(p):
            return False
        raise
    finally:
        fs.delete(own, False)
    return True


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_if_exists(spark: SparkSession, path: str) -> bytes | None:
    fs, p = _at(spark, path)
    return read(spark, path) if fs.exists(p) else None


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without those that are still being written."""
    fs, p = _at(spark, path)
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.delete(p, True)
