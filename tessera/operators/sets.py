"""Distinct values, hierarchy children and period contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from . import filters as flt


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-blank values, sorted as text."""
    return (df.select(F.col(col).cast("string").alias("value"))
            .where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct().orderBy("value"))


def cascade_children(df: DataFrame, prefix: dict[str, str], child: str) -> DataFrame:
    """Sorted distinct children under a prefix of the hierarchy (accent/case-insensitive)."""
    return distinct_values(flt.cascade_filter(df, prefix), child).withColumnRenamed("value", "child")


def period_values(df: DataFrame, period: int, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    """Groups present in a period, and the measures that have any non-null value there."""
    p = df.where(F.col(b.period) == F.lit(period))
    groups = p.select(F.lit("group").alias("kind"), F.col(b.group_name).alias("value")).distinct()
    counts = p.agg(*[F.count(m).alias(m) for m in measures])
    ms = (counts.unpivot([], measures, "value", "n").where(F.col("n") > 0)
          .select(F.lit("measure").alias("kind"), "value"))
    return groups.unionByName(ms)
