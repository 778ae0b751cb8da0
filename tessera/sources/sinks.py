"""Sinks: whole-table writes through Spark's committer (atomic per job)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: tuple = ()) -> None:
    """Write records (parquet / json lines / csv); the output committer makes the result
    appear only when every task has succeeded, which replaces the reference's temp-file swap."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
