"""How old source files are, as their file system reports it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.period import is_stale, source_freshness
from .prepared import path_exists


def first_source(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the candidate paths that is there (the columnar copy is named before the original)."""
    return next((p for p in candidates if path_exists(spark, p)), None)


def source_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, bytes, modified: a row per file at the paths (folders at any depth). No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"),
                        F.col("modificationTime").alias("modified"))


def file_freshness(spark: SparkSession, paths: list[str], as_of: str | None = None, stale_days: int = 500) -> DataFrame:
    """Per source file: its time, the date shown for it (a month back), the same by the reference's rule
    for December, and whether it is older than ``stale_days`` at ``as_of`` (today, by default)."""
    now = as_of if as_of is not None else spark.range(1).select(F.current_date().cast("string")).first()[0]
    return source_files(spark, paths).select(
        "file", "bytes", "modified", source_freshness("modified").alias("shown"),
        source_freshness("modified", reference_mode=True).alias("shown_reference"), is_stale("modified", now, stale_days).alias("stale"))
