"""Session helpers: one builder for tests/bench, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", app: str = "tessera", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and bench. On a cluster the caller's session is used as is."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1) * 2)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.driver.memory", "16g")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), as the URI that the session names.

    Only a local master may go without the setting: tests then get a scratch folder. On a cluster a
    missing setting is an error, because executors do not share a machine's temporary folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if _SET.get(sc.applicationId) != d:
        sc.setCheckpointDir(d)  # once: every call makes a subfolder
        _SET.clear()
        _SET[sc.applicationId] = d
    return d


_SET: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared folder (set from the session's
    ``spark.checkpoint.dir`` first): cuts lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
