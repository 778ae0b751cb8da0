"""Rescans of an image tree as a keyed change table with validity intervals.

A rescan (snapshot) is a folder of flattened image rows, named in time order. The table holds no copy
of a rescan, only what changed in it: a row per file and rescan with the status ``new``, ``updated`` or
``removed`` and the file's values, valid from that rescan until the file's next change. Unchanged files
have no row and so keep the name and size of their last change.

A part that arrives late, for a rescan that was merged before, may change what its own keys look like
there and in later rescans, and nothing else: the history of these keys is worked out again from that
rescan on and appended. Of the rows of one file and rescan, the one written last holds (``batch``,
``step``); ``unchanged`` and ``absent`` rows only take back earlier ones. Nothing is ever rewritten,
and a replayed batch rewrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.prepared import path_exists

BATCH, STEP, SNAPSHOT, STATUS = "batch", "step", "snapshot", "status"
#: Statuses that hold a file's values or end them; the others take back earlier rows. ``scanned`` marks a merged rescan.
CHANGES, SCANNED = ("new", "updated", "removed"), "scanned"
KEY, NAME, SIZE, MODIFIED = "file_id", "file_name", "size", "modified"


def _log(spark: SparkSession, table_dir: str, schema: StructType) -> DataFrame:
    """All rows ever appended, with the batch and step that wrote them."""
    full = StructType([*schema.fields]).add(SNAPSHOT, "string").add(STATUS, "string").add(BATCH, "long").add(STEP, "integer")
    return spark.read.schema(full).parquet(table_dir) if path_exists(spark, table_dir) else spark.createDataFrame([], full)


def _before(log: DataFrame, batch: int, step: int) -> DataFrame:
    """What was written before a step: a replayed batch does not see its own earlier run."""
    return log.where((F.col(BATCH) < batch) | ((F.col(BATCH) == batch) & (F.col(STEP) < step)))


def changes(log: DataFrame) -> DataFrame:
    """The change rows that hold: the last written of each file and rescan, if it is a change."""
    values = [c for c in log.columns if c not in (KEY, SNAPSHOT, BATCH, STEP)]
    last = log.where(F.col(STATUS) != SCANNED).groupBy(KEY, SNAPSHOT).agg(
        F.max_by(F.struct(*values), F.struct(BATCH, STEP)).alias("r"))
    return last.select(KEY, SNAPSHOT, *[F.col(f"r.{c}").alias(c) for c in values]).where(F.col(STATUS).isin(*CHANGES))


def state_at(log: DataFrame, snapshot: str | None = None, before: bool = False) -> DataFrame:
    """The files that are there at a rescan (or right before it; the last one by default), with the values
    of their last change."""
    held = changes(log)
    if snapshot is not None:
        held = held.where(F.col(SNAPSHOT) < snapshot if before else F.col(SNAPSHOT) <= snapshot)
    values = [c for c in held.columns if c not in (KEY, SNAPSHOT)]
    now = held.groupBy(KEY).agg(F.max_by(F.struct(*values), SNAPSHOT).alias("r"))
    return now.select(KEY, *[F.col(f"r.{c}").alias(c) for c in values]).where(F.col(STATUS) != "removed").drop(STATUS)


def images_at(spark: SparkSession, table_dir: str, schema: StructType, snapshot: str | None = None) -> DataFrame:
    """The merged files of a rescan, in the columns of ``schema``."""
    return state_at(_log(spark, table_dir, schema), snapshot).select(*schema.names)


def intervals(spark: SparkSession, table_dir: str, schema: StructType) -> DataFrame:
    """valid_from, valid_to (exclusive; null: still valid) of every version of every file."""
    held = changes(_log(spark, table_dir, schema))
    until = F.lead(SNAPSHOT).over(Window.partitionBy(KEY).orderBy(SNAPSHOT))  # a file has few changes
    return held.withColumn("valid_to", until).where(F.col(STATUS) != "removed").select(
        *schema.names, F.col(SNAPSHOT).alias("valid_from"), "valid_to")


def _whole_scan(log: DataFrame, scan: DataFrame, snapshot: str) -> DataFrame:
    """Changes of a rescan that follows all others: its files against the state before it."""
    old = state_at(log).select(KEY, F.col(MODIFIED).alias("o_modified"), F.lit(True).alias("o_there"))
    both = scan.withColumn("n_there", F.lit(True)).join(old, KEY, "full")
    status = (F.when(F.col("o_there").isNull(), "new").when(F.col("n_there").isNull(), "removed")
              .when(~F.col("o_modified").eqNullSafe(F.col(MODIFIED)), "updated"))
    return both.withColumn(STATUS, status).where(F.col(STATUS).isNotNull()).select(
        *scan.columns, F.lit(snapshot).alias(SNAPSHOT), STATUS)


def _history(log: DataFrame, scans: DataFrame, keys: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Every step of the given keys through the rescans ``names`` (ascending), from the state before them."""
    start = state_at(log, names[0], before=True).join(keys, KEY, "left_semi").select(*columns).withColumn(SNAPSHOT, F.lit("")).withColumn("there", F.lit(True))
    seen = scans.join(keys, KEY, "left_semi").select(*columns, SNAPSHOT).withColumn("there", F.lit(True))
    grid = keys.select(KEY, F.explode(F.array(F.lit(""), *[F.lit(n) for n in names])).alias(SNAPSHOT))
    steps = grid.join(start.unionByName(seen), [KEY, SNAPSHOT], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    w = Window.partitionBy(KEY).orderBy(SNAPSHOT)  # a row per rescan
    was, had = F.lag("there").over(w), F.lag(MODIFIED).over(w)
    status = (F.when(F.col("there") & ~was, "new").when(~F.col("there") & was, "removed").when(~F.col("there"), "absent")
              .when(had.eqNullSafe(F.col(MODIFIED)), "unchanged").otherwise("updated"))
    return steps.withColumn(STATUS, status).where(F.col(SNAPSHOT) != "").select(*columns, SNAPSHOT, STATUS)


def _write_counts(log: DataFrame, counts_dir: str, names: list[str], previous: str | None) -> None:
    """Files by status for the rescans ``names``, from their changes and the count of the one before."""
    spark = log.sparkSession
    by = {n: {} for n in names}
    for r in changes(log).where(F.col(SNAPSHOT).isin(names)).groupBy(SNAPSHOT, STATUS).agg(F.count(F.lit(1)).alias("n")).collect():  # three rows a rescan
        by[r[SNAPSHOT]][r[STATUS]] = r["n"]
    there = 0
    if previous is not None:
        there = spark.read.parquet(f"{counts_dir}/snapshot={previous}").where("status <> 'removed'").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    for n in names:
        c = by[n]
        c["unchanged"] = there - c.get("updated", 0) - c.get("removed", 0)
        there = c["unchanged"] + c.get("updated", 0) + c.get("new", 0)
        rows = [(s, v) for s, v in sorted(c.items()) if v > 0]
        spark.createDataFrame(rows, "status string, files long").coalesce(1).write.mode("overwrite").parquet(f"{counts_dir}/snapshot={n}")


def incremental_image_sync(spark: SparkSession, snapshots_dir: str, schema: StructType, table_dir: str, checkpoint: str) -> None:
    """Merge every rescan that has new files into the change table; status counts go to
    ``<table_dir>_counts/snapshot=<name>``.

    A rescan that follows all merged ones is read whole, once, and compared with the state before it. New
    files of a rescan that was merged before, or of one that arrives out of order, redo their own keys
    from that rescan on (out of order, the keys that were there before too: they may be gone in it).
    Rows without a file id are new in every rescan. File ids name one file in a rescan."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)

    def merge(batch: DataFrame, epoch_id: int) -> None:
        fresh = sorted(r[0] for r in batch.select(SNAPSHOT).distinct().collect())  # one name per rescan
        for step, name in enumerate(fresh):
            log = _before(_log(spark, table_dir, schema), epoch_id, step)
            done = sorted(r[0] for r in log.where(F.col(STATUS) == SCANNED).select(SNAPSHOT).distinct().collect())
            if not done or name > done[-1]:
                rows, names = _whole_scan(log, spark.read.schema(schema).parquet(f"{snapshots_dir}/{name}"), name), [name]
            else:
                names = sorted({name, *(n for n in done if n > name)})
                keys = batch.where(F.col(SNAPSHOT) == name).select(KEY).distinct()
                if name not in done:
                    keys = keys.unionByName(state_at(log, name, before=True).select(KEY)).distinct()
                scans = (spark.read.schema(schema).parquet(*[f"{snapshots_dir}/{n}" for n in names])
                         .withColumn(SNAPSHOT, folder))
                rows = _history(log, scans, keys.where(F.col(KEY).isNotNull()), names, schema.names)
            mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                                         F.lit(name).alias(SNAPSHOT), F.lit(SCANNED).alias(STATUS))
            rows.unionByName(mark).write.mode("overwrite").parquet(f"{table_dir}/{BATCH}={epoch_id}/{STEP}={step}")
            earlier = [n for n in done if n < name]
            _write_counts(_before(_log(spark, table_dir, schema), epoch_id, step + 1), f"{table_dir}_counts", names, earlier[-1] if earlier else None)

    q = (spark.readStream.schema(schema).parquet(f"{snapshots_dir}/*").select("*", folder.alias(SNAPSHOT))
         .writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
