"""Positional semantics (first/last per key, ranks, shares) and top-k.

"First"/"last" per key are aggregates (``min_by``/``max_by`` over an explicit order column),
not windows, so a key holding a third of all rows is still reduced map-side. Ordered windows
are only used on aggregated results (<= #groups rows) or with a ``row_number() <= k`` filter,
which Spark turns into a partial group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..binding import DEFAULT, Binding
from ..functions.numbers import pct_int


def first_per_key(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; all columns kept.

    Rows are reduced before the shuffle (one row per key and task), so a hot key stays small; a
    struct is no type for a hash aggregate, so this costs a sort by key on either side."""
    cols = [c for c in df.columns if c != key]
    ordk = F.struct(*[F.col(c) for c in order])
    pick = F.max_by if last else F.min_by
    g = df.groupBy(key).agg(pick(F.struct(*[F.col(c) for c in cols]), ordk).alias("__r"))
    return g.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def dedup_keep_first(df: DataFrame, key: str, order: list[str], valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """First *valid* row per key, plus one row with the number of duplicates dropped."""
    src = df.where(valid) if valid is not None else df
    kept = first_per_key(src, key, order)
    dups = src.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
    return kept, dups


def index_last_row_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Normalised key (trim/upper) -> position (``order_col``) of its last row."""
    k = F.upper(F.trim(F.col(key).cast("string")))
    return df.groupBy(k.alias("key")).agg(F.max(order_col).alias("last_position"))


def rank_small(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position after sorting. For aggregated (small) frames only: one ordered window."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def share_of_total(df: DataFrame, value: str, out: str = "share", scale: int = 2) -> DataFrame:
    """value / sum(value) * 100; the total is a scalar subquery (no global window)."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, pct_int(F.col(value), total, scale))


def top_k_per(df: DataFrame, part: str, order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """Rows with ``row_number() <= k`` per ``part`` (partial limit before the shuffle)."""
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)


def leader_per_measure(df: DataFrame, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    """Per measure: sum, the facility with the largest value (ties: smallest key), its value and
    its share of the sum (1 dec.); measures whose sum <= 0 are skipped."""
    long = df.select(b.facility, *[F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias(m) for m in measures]) \
        .unpivot([b.facility], measures, "measure", "value")
    # one aggregate: the smallest (-value, key) is the largest value with the smallest key
    g = long.groupBy("measure").agg(
        F.sum("value").cast("bigint").alias("total"), F.max("value").alias("leader_value"),
        F.min_by(F.col(b.facility), F.struct(-F.col("value"), F.col(b.facility))).alias("leader"))
    out = g.where(F.col("total") > 0)
    return out.withColumn("leader_pct", pct_int("leader_value", "total", 1))


def top_groups_by_measure(groups: DataFrame, measure: str, n: int = 5, name_col: str = "group_name") -> DataFrame:
    if measure not in groups.columns:
        return groups.limit(0)
    return groups.orderBy(F.col(measure).desc(), F.col(name_col)).limit(n)
