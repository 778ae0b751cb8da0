"""Incremental loads with Structured Streaming.

Monthly files land in a folder in any layout; a file-source stream picks them up. One *load* is all
that one stream checkpoint ever reads: its batches append to the periods they carry, so a period may
be spread over many files and batches, and a late file adds to it. A new load (a new checkpoint)
replaces the periods that it touches as a whole; older loads stay on disk and are not read.

Every batch writes its rows (partitioned by period) and its partial aggregates (a row per period and
group) in folders of its own, so a replayed batch rewrites the same files. The
group summary is a sum of partial aggregates: rows that were loaded are never read again for it. It is
brought up to date when a run has taken all that is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..sources.panel import sink_panel_partitioned
from ..sources.prepared import path_exists


def period_summary(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Per period and group: rows, operating rows and the certificate sums. Sums of such rows over the
    batches of a load are the summary of the load (``merge_partials``)."""
    return (df.groupBy(b.period, b.group_id)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col(b.status) == b.operating_code).cast("bigint").alias("operating"),
                 *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"sum_{c}") for c in (*b.levels, "cn_total")]))


LOAD, BATCH = "load_version", "load_batch"


def load_version(spark: SparkSession, panel_path: str, checkpoint: str) -> int:
    """The version of the load that ``checkpoint`` stands for: as noted when it began, else the next."""
    notes = f"{panel_path}_loads"
    known = {r["checkpoint"]: r["version"] for r in spark.read.parquet(notes).collect()} if path_exists(spark, notes) else {}  # a row per load
    if checkpoint not in known:
        known[checkpoint] = max(known.values(), default=0) + 1
        note = spark.range(1).coalesce(1).select(F.lit(checkpoint).alias("checkpoint"), F.lit(known[checkpoint]).alias("version"))
        note.write.mode("append").parquet(notes)
    return known[checkpoint]


def _partials(panel_path: str) -> str:
    return f"{panel_path}_partials"


def newest_partials(spark: SparkSession, panel_path: str, b: Binding = DEFAULT) -> DataFrame:
    """The partial aggregates of each period's newest load."""
    parts = spark.read.parquet(_partials(panel_path))
    newest = parts.groupBy(b.period).agg(F.max(LOAD).alias(LOAD))  # partials are small: a row per batch, period and group
    return parts.join(newest, [b.period, LOAD], "left_semi")


def merge_partials(parts: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Partial aggregates of any number of batches -> one row per period and group."""
    keys = [b.period, b.group_id]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*keys, LOAD, BATCH)])


def current_panel(spark: SparkSession, panel_path: str, b: Binding = DEFAULT, periods: list | None = None) -> DataFrame:
    """The rows of each period's newest load (of ``periods`` only, if given), as the partials name it."""
    df, newest = spark.read.parquet(panel_path), newest_partials(spark, panel_path, b).select(b.period, LOAD).distinct()
    if periods is not None:
        df, newest = df.where(F.col(b.period).isin(periods)), newest.where(F.col(b.period).isin(periods))
    return df.join(newest, [b.period, LOAD], "left_semi").drop(LOAD, BATCH)


def refresh_summary(spark: SparkSession, panel_path: str, summary_path: str, b: Binding = DEFAULT) -> None:
    """Sum the partials of the newest loads: one small table, written anew. A refresh that broke off is
    made good by the next one."""
    merge_partials(newest_partials(spark, panel_path, b), b).write.mode("overwrite").parquet(summary_path)


def incremental_period_load(spark: SparkSession, source_dir: str, schema, panel_path: str, summary_path: str,
                            checkpoint: str, b: Binding = DEFAULT, files_per_trigger: int | None = None) -> None:
    """Process every file present in ``source_dir`` (Trigger.AvailableNow), refresh the summary and stop."""
    version = load_version(spark, panel_path, checkpoint)

    def load(batch: DataFrame, epoch_id: int) -> None:
        own = f"{LOAD}={version}/{BATCH}={epoch_id}"
        # ranges of (period, facility): a period is contiguous, and a large one is cut across many tasks, by its rows
        sink_panel_partitioned(batch, f"{panel_path}/{own}", (b.period,), b.facility, tasks=spark.sparkContext.defaultParallelism)
        # last: a period of a batch counts as loaded once its partials are there
        period_summary(batch, b).write.mode("overwrite").parquet(f"{_partials(panel_path)}/{own}")

    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    q = (reader.parquet(source_dir).writeStream.foreachBatch(load)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if path_exists(spark, _partials(panel_path)):
        refresh_summary(spark, panel_path, summary_path, b)
