"""Panel scans, period sources and the partitioned panel sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import DEFAULT
from .prepared import path_exists
from .tables import bounded_broadcast


def scan_pruned(src: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Only the wanted columns that exist (Parquet reads just those); the missing ones are reported."""
    have = set(src.columns)
    return src.select(*[c for c in wanted if c in have]), [c for c in wanted if c not in have]


def period_source_union(local: DataFrame, history: DataFrame, period_col: str = "period_key") -> DataFrame:
    """Each period from the local table if it has it, else from the historical store (local
    always wins). Adds ``source``. The set of local periods is small and size-checked before
    it is broadcast into the anti join."""
    periods = bounded_broadcast(local.select(period_col).distinct())
    hist = history.join(periods, period_col, "left_anti")
    return (local.withColumn("source", F.lit("local"))
            .unionByName(hist.withColumn("source", F.lit("history")), allowMissingColumns=True))


#: Rows of one write task, which sorts them by partition: some 300 bytes each in memory, whatever they take in files.
ROWS_PER_WRITER = 500_000


def tasks_for_rows(rows: int) -> int:
    return max(-(-rows // ROWS_PER_WRITER), 1)


def writer_tasks(df: DataFrame) -> int:
    """Number of write tasks from a count of the rows (a Parquet scan answers it from its footers). Sizes
    of files do not tell it: equal rows take many times less there than in a task."""
    return tasks_for_rows(df.count())


def sink_panel_partitioned(df: DataFrame, path: str, partition_cols=("period_key",), spread_key: str | None = None,
                           tasks: int | None = None, rows: int | None = None) -> None:
    """Parquet, snappy, partitioned (partitions replace the reference's row-position indexes).

    Rows are range-partitioned on (partition columns, ``spread_key``) into writers of about
    ROWS_PER_WRITER rows, ``tasks`` at least. ``rows``, an estimate that the caller has, saves their count.
    Range boundaries come from a sample, so a month that holds a third of all rows is cut across many
    tasks, each task writes one contiguous slice (few files), and no month is funnelled into a single task."""
    n = max(tasks or 1, writer_tasks(df) if rows is None else tasks_for_rows(rows))
    keys = [F.col(c) for c in partition_cols] + ([F.col(spread_key)] if spread_key else [])
    (df.repartitionByRange(n, *keys).write.mode("overwrite").option("compression", "snappy")
     .partitionBy(*partition_cols).parquet(path))


def first_load_materialise(spark: SparkSession, raw: DataFrame, path: str, partition_cols=("period_key",),
                           spread_key: str | None = DEFAULT.facility) -> DataFrame:
    """Write the table only if it does not exist yet (``ignore`` mode), then read it. Rows are
    range-partitioned by the partition columns and ``spread_key`` (if the table has it): a partition has
    few files, and a large one is cut across many tasks."""
    if not path_exists(spark, path):  # else its rows would be counted for nothing
        keys = [F.col(c) for c in (*partition_cols, spread_key) if c in raw.columns]
        (raw.repartitionByRange(writer_tasks(raw), *keys).write.mode("ignore").option("compression", "snappy")
         .partitionBy(*partition_cols).parquet(path))
    return spark.read.parquet(path)
