"""The hierarchy of a panel as a prefix table, built in one scan.

The rows of the panel reduce to the distinct paths as they are spelled. Each of these goes up to all
its prefixes, and one aggregate makes the places of every level out of them, with the first spelling
carried along: one shuffle for all levels, reduced map-side, so that a hot place moves one row a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.text import norm_text, norm_text_lit
from ..session import scratch_path
from ..sources.tables import bounded_broadcast
from . import filters as flt

LEVELS = ("group", "zone", "municipality", "locality", "facility")
PATHS = tuple(f"{n}_norm" for n in LEVELS)


def prefix_table(df: DataFrame, b: Binding = DEFAULT, order_col: str | None = None) -> DataFrame:
    """level (1 = group .. 5 = facility), the normalised path (null below the level), name and rows: a row
    for every place of every level.

    ``name`` is the first spelling of the place's own part: that of the least ``order_col``, ties to the
    smaller text; without ``order_col`` the smallest. Rows with a blank part are left out."""
    columns = b.hierarchy()
    src = flt.drop_incomplete_hierarchy(df, columns)
    spelled = src.select(*columns, (F.col(order_col) if order_col else F.lit(0)).alias("__o")).groupBy(*columns).agg(
        F.min("__o").alias("__o"), F.count(F.lit(1)).alias("rows"))
    # rows are normalised after they are reduced
    norm = spelled.select(*[norm_text(c).alias(p) for c, p in zip(columns, PATHS)], *[F.col(c).alias(f"d{i}") for i, c in enumerate(columns)], "__o", "rows")
    up = [F.struct(F.lit(i + 1).alias("level"), *[(F.col(p) if k <= i else F.lit(None).cast("string")).alias(p) for k, p in enumerate(PATHS)],
                   F.struct(F.col("__o").alias("o"), F.col(f"d{i}").alias("d")).alias("first")) for i in range(5)]
    places = norm.select(F.inline(F.array(*up)), "rows").groupBy("level", *PATHS).agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    return places.select("level", *PATHS, F.col("first.d").alias("name"), "rows")


def write_prefix_table(df: DataFrame, path: str, b: Binding = DEFAULT, order_col: str | None = None) -> DataFrame:
    """The prefix table as a prepared table, one partition a level: look-ups read their level only."""
    prefix_table(df, b, order_col).write.mode("overwrite").partitionBy("level").parquet(path)
    return read_prefix_table(df.sparkSession, path)


def read_prefix_table(spark, path: str) -> DataFrame:
    schema = "level int, " + ", ".join(f"{p} string" for p in PATHS) + ", name string, rows long"
    return spark.read.schema(schema).parquet(path)


def children_of(table: DataFrame, *path: str) -> DataFrame:
    """name (without blanks at its ends), rows of the places right below a path of names (accents, case and
    blanks do not count); no path gives the groups. An unknown path has no rows."""
    below = table.where(F.col("level") == len(path) + 1)
    for p, name in zip(PATHS, path):
        below = below.where(F.col(p) == F.lit(norm_text_lit(name)))
    return below.select(F.trim("name").alias("name"), "rows").orderBy("name")


def index_of(table: DataFrame) -> DataFrame:
    """Every facility's path with the spelling of each of its places, its rows and its group's rows. The
    higher levels join by their path; those within the size bound are broadcast."""
    out = table.where("level = 5").select(*PATHS, F.col("name").alias("facility"), "rows")
    for i in (3, 2, 1, 0):
        names = table.where(F.col("level") == i + 1).select(*PATHS[:i + 1], F.col("name").alias(LEVELS[i]), *([F.col("rows").alias("group_rows")] if i == 0 else []))
        out = out.join(bounded_broadcast(names), list(PATHS[:i + 1]))
    return out.select(*PATHS, *LEVELS, "rows", "group_rows")


def hierarchy_index(df: DataFrame, b: Binding = DEFAULT, order_col: str | None = None) -> DataFrame:
    """Distinct normalised (group, zone, municipality, locality, key) tuples with the display spelling
    of each level, the row count of the tuple and of its group: the panel is scanned once, into a written
    prefix table, and the levels of that table are joined."""
    path = scratch_path(df.sparkSession, f"prefix-{uuid.uuid4().hex}")
    return index_of(write_prefix_table(df, path, b, order_col))
