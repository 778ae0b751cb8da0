"""Prepared tables: written once for each state of their source files, then read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..session import scratch_path


def fingerprint(spark: SparkSession, paths: list[str], version: str = "") -> str:
    """Of the files at the paths (folders: all files right in them) as their own file system reports them
    (path, size, time), and of ``version``, the state of the code that prepares. No file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1(version.encode())
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        status = fs.getFileStatus(p)
        found = fs.listStatus(p) if status.isDirectory() else [status]
        h.update("".join(sorted(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}\n" for x in found)).encode())
    return h.hexdigest()[:16]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def completed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (``_SUCCESS``)."""
    return path_exists(spark, f"{path}/_SUCCESS")


def prepared(spark: SparkSession, name: str, sources: list[str], version: str, last: str, build: Callable[[str], None]) -> str:
    """The folder of the prepared tables ``name`` for the present state of ``sources``; ``build`` writes them
    if the table ``last`` (the one that it writes last; '' if it writes one) is not there."""
    folder = scratch_path(spark, f"{name}-{fingerprint(spark, sources, version)}")
    if not completed(spark, f"{folder}/{last}".rstrip("/")):
        build(folder)
    return folder
