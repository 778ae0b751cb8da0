"""Readers for the driver's parquet tables and a size-checked broadcast helper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's parquet table; the DataFrame (file listing, footer schema) is reused per
    session. Reading is still lazy: every query scans only the columns and rows it needs."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def literal_rows(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A few fixed rows as constants of the plan. Unlike rows of an RDD, they have a size that Catalyst
    knows, so a join with them is a broadcast and never a shuffle of the other side by a few values."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


def plan_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan (file sizes for scans); no job runs."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. Spark Connect)
        return None


def input_size_bytes(df: DataFrame) -> int | None:
    """Sum of the leaf relations' sizes (file sizes for scans): what the plan reads. Unlike the
    estimate of a join's output, this never explodes."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # noqa: BLE001
        return None


def partition_values(df: DataFrame, column: str) -> list | None:
    """The values of a partition column of the files that ``df`` reads, from its file listing; no file is
    read. None if ``df`` is more than columns of one partitioned table, or ``column`` no partition of it."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() == "Project" and all(plan.projectList().apply(i).getClass().getSimpleName() == "AttributeReference"
                                                   for i in range(plan.projectList().size())):
            plan = plan.children().apply(0)
        if not plan.getClass().getSimpleName() == "LogicalRelation":
            return None
        spec = plan.relation().location().partitionSpec()
        names = list(spec.partitionColumns().fieldNames())
        if column not in names:
            return None
        at, kind = names.index(column), spec.partitionColumns().fields()[names.index(column)].dataType()
        parts = spec.partitions()
        return [parts.apply(i).values().get(at, kind) for i in range(parts.size())]
    except Exception:  # noqa: BLE001 - no listing (another source, e.g. Spark Connect): callers aggregate instead
        return None


def bounded_broadcast(df: DataFrame, max_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast of ``df`` only if Catalyst's own size estimate (file sizes of what the plan
    reads) is within ``max_bytes``. No job runs; beyond the bound, or without an estimate, the frame
    is returned as it is and AQE chooses the join from the sizes it measures."""
    est = plan_size_bytes(df)
    return F.broadcast(df) if est is not None and est <= max_bytes else df
