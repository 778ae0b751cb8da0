"""Grouped aggregations over a panel.

All are hash aggregates with a partial (map-side) step, so a hot group only ever moves one
partial row per task across the shuffle. Totals over groups are taken from the already
aggregated frame (a few dozen rows), never with a window over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.numbers import clamp_nonneg, pct_int, to_number
from ..functions.text import norm_text
from . import filters as flt


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def agg_by_group_clamped(df: DataFrame, b: Binding = DEFAULT, status: int = -1,
                         measures=None) -> DataFrame:
    """Per group: rows, and sums of the compare measures with nulls and negatives as 0.
    Optional status filter (-1 = any); null group dropped."""
    ms = measures or b.compare_measures
    src = df.where(F.col(b.group_id).isNotNull())
    if status >= 0:
        src = src.where(F.col(b.status) == F.lit(status))
    return src.groupBy(b.group_id).agg(
        F.count(F.lit(1)).alias("facilities"),
        *[F.sum(clamp_nonneg(F.col(c).cast("bigint"))).cast("bigint").alias(o) for o, c in ms])


def agg_by_group_plain(df: DataFrame, b: Binding = DEFAULT, measures=None) -> DataFrame:
    """Per group: rows and sums with non-numeric -> 0, negatives kept, truncated to int."""
    ms = measures or b.compare_measures
    gid = to_number(b.group_id).try_cast("int")
    src = df.withColumn("__gid", gid).where(F.col("__gid").isNotNull())
    return src.groupBy(F.col("__gid").alias(b.group_id)).agg(
        F.count(F.lit(1)).alias("facilities"),
        *[F.sum(F.coalesce(to_number(c), F.lit(0.0))).try_cast("bigint").alias(o) for o, c in ms])


def grand_totals(groups: DataFrame, cols: list[str]) -> DataFrame:
    """Totals over already-aggregated group rows."""
    return groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


def annual_accumulate(df: DataFrame, b: Binding = DEFAULT, clamp: bool = False, measures=None) -> DataFrame:
    """Per year and group: summed monthly aggregates; facility count becomes facility-months."""
    ms = measures or b.compare_measures
    val = (lambda c: clamp_nonneg(F.col(c).cast("bigint"))) if clamp else \
        (lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)))
    return (df.where(F.col(b.group_id).isNotNull())
            .groupBy(b.year, b.group_id)
            .agg(F.count(F.lit(1)).alias("facility_months"),
                 *[F.sum(val(c)).cast("bigint").alias(o) for o, c in ms]))


def facilities_per_group_distinct(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    return df.groupBy(b.group_name).agg(F.count_distinct(b.facility).alias("facilities"))


def rows_per_group(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    return df.groupBy(b.group_id).agg(F.count(F.lit(1)).alias("rows"))


def operating_per_group(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    return df.groupBy(b.group_id).agg(_count_if(flt.operating(b)).alias("operating"))


def connected_per_group(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Operating rows, operating-and-connected rows (strict list), % of operating (1 dec.)."""
    op = flt.operating(b)
    g = df.groupBy(b.group_id).agg(_count_if(op).alias("operating"),
                                   _count_if(op & flt.connected_strict(b)).alias("connected"))
    return g.withColumn("pct_connected", pct_int("connected", "operating", 1))


def connectivity_rate_by_group(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Share of rows with the loose connectivity flag (all rows as denominator), 2 dec."""
    g = df.groupBy(b.group_name).agg(F.count(F.lit(1)).alias("rows"),
                                     _count_if(flt.connected_loose(b)).alias("connected"))
    return g.withColumn("pct_connected", pct_int("connected", "rows", 2))


STATUS_CODES = (0, 1, 2, 3, 4)


def status_pivot(df: DataFrame, b: Binding = DEFAULT, codes=STATUS_CODES) -> DataFrame:
    """Distinct facilities per group x status (explicit pivot values: stable schema, no extra
    job), row total, and operating / suspended shares (2 dec.)."""
    # distinct (group, status, key) first: one shuffle spread over all keys, then a plain
    # pivoted count (partial aggregation), instead of one distinct aggregate per pivot value
    # the pivot is written as one conditional count per explicit status value, so the
    # distinct rows feed a single grouped aggregate (two shuffles in all)
    names = {c: f"status_{c}" for c in codes}
    p = (df.select(b.group_name, b.status, b.facility).where(F.col(b.facility).isNotNull()).distinct()
         .groupBy(b.group_name)
         .agg(*[F.count_if(F.col(b.status) == F.lit(c)).cast("bigint").alias(v) for c, v in names.items()]))
    total = sum((F.col(v) for v in names.values()), F.lit(0))
    return (p.withColumn("total", total.cast("bigint"))
            .withColumn("pct_operating", pct_int("status_1", "total", 2))
            .withColumn("pct_suspended", pct_int("status_0", "total", 2)))


def status_distribution(df: DataFrame, b: Binding = DEFAULT, labels: DataFrame | None = None) -> DataFrame:
    """Rows per status with % of all rows (2 dec.), most frequent first."""
    g = df.groupBy(F.col(b.status).alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    total = g.agg(F.sum("rows")).scalar()
    out = g.withColumn("pct", pct_int(F.col("rows"), total, 2))
    if labels is not None:
        from .dims import dim_decode
        out = dim_decode(out, "status", labels, "status_name", "Situación_")
        out = out.withColumn("status_name", F.when(F.col("status").isNull(), F.lit(MISSING_STATUS))
                             .otherwise(F.col("status_name")))
    return out


# Label of rows without a status.
MISSING_STATUS = "Sin información"


def measure_summary(df: DataFrame, measures: list[str], is_latest: Column, b: Binding = DEFAULT) -> DataFrame:
    """Per measure over all history: rows, nulls, % null, sum; over the latest month
    (``is_latest``): operating facilities with value > 0. Plus a combined TOTAL row (sum of
    sums, all operating facilities). One pass: a single conditional aggregate, then the
    one-row result is unpivoted."""
    df = df.withColumn("__latest", is_latest)  # one scalar subquery, evaluated once per row
    op = flt.operating(b) & F.col("__latest")
    one = df.agg(F.count(F.lit(1)).alias("rows"), _count_if(op).alias("op_all"),
                 *[F.count_if(F.col(m).isNull()).cast("bigint").alias(f"n_{m}") for m in measures],
                 *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(f"s_{m}") for m in measures],
                 *[_count_if(op & (F.coalesce(F.col(m), F.lit(0)) > 0)).alias(f"p_{m}") for m in measures])
    parts = [F.struct(F.lit(m).alias("measure"), F.col("rows"), F.col(f"n_{m}").alias("nulls"),
                      F.col(f"s_{m}").alias("total"), F.col(f"p_{m}").alias("operating_positive"))
             for m in measures]
    parts.append(F.struct(F.lit("TOTAL").alias("measure"), F.col("rows"), F.lit(0).cast("bigint").alias("nulls"),
                          sum((F.col(f"s_{m}") for m in measures), F.lit(0)).cast("bigint").alias("total"),
                          F.col("op_all").alias("operating_positive")))
    rows = one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    return rows.withColumn("pct_null", pct_int("nulls", "rows", 2))


def group_measure_totals(df: DataFrame, b: Binding = DEFAULT, levels=None) -> DataFrame:
    """Per group: sum of each level (nulls 0), their total, and % of the national total (2 dec.)."""
    lv = list(levels or b.levels)
    g = df.groupBy(b.group_id).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"sum_{c}") for c in lv])
    g = g.withColumn("sum_total", sum((F.col(f"sum_{c}") for c in lv), F.lit(0)).cast("bigint"))
    national = g.agg(F.sum("sum_total")).scalar()
    return g.withColumn("pct_of_national", pct_int(F.col("sum_total"), national, 2))


def ratio_sums(df: DataFrame, total_col: str, part_col: str, prefix: str) -> DataFrame:
    """Σ total, Σ part (numeric coercion) and part/total % (2 dec.)."""
    t = F.coalesce(F.sum(F.coalesce(to_number(total_col), F.lit(0.0))), F.lit(0.0)).try_cast("bigint")
    p = F.coalesce(F.sum(F.coalesce(to_number(part_col), F.lit(0.0))), F.lit(0.0)).try_cast("bigint")
    g = df.agg(t.alias(f"{prefix}_total"), p.alias(f"{prefix}_part"))
    return g.withColumn(f"{prefix}_pct", pct_int(f"{prefix}_part", f"{prefix}_total", 2))


def coerced_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """Σ of each column after numeric coercion (bad -> 0), truncated to int."""
    return df.agg(*[F.coalesce(F.sum(F.coalesce(to_number(c), F.lit(0.0))), F.lit(0.0))
                    .try_cast("bigint").alias(f"sum_{c}") for c in cols])


def _distinct(df: DataFrame, col: str) -> Column:
    """Number of distinct values of one column as a scalar: one grouped distinct, so that several of
    them do not multiply the rows of one aggregate."""
    return df.select(col).where(F.col(col).isNotNull()).groupBy(col).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).scalar()


def dataset_counters(df: DataFrame, is_latest: Column, b: Binding = DEFAULT) -> DataFrame:
    """Distinct facilities, rows, distinct groups (all history) and rows in the latest month."""
    one = df.select(is_latest.alias("__latest")).agg(F.count(F.lit(1)).alias("rows"), _count_if(F.col("__latest")).alias("rows_latest"))
    return one.select(_distinct(df, b.facility).alias("facilities"), "rows", _distinct(df, b.group_id).alias("groups"), "rows_latest")


def dataset_profile(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Rows, columns, distinct groups/facilities, sorted distinct years and months (as text)."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_join(F.sort_array(F.collect_set(F.col(b.year).cast("string"))), ",").alias("years"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.col(b.month).cast("int"))),
                                 lambda x: x.cast("string")), ",").alias("months"))
    return one.select("rows", F.lit(len(df.columns)).alias("columns"), _distinct(df, b.group_id).alias("groups"),
                      _distinct(df, b.facility).alias("facilities"), "years", "months")


def column_distinct_ratio(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """distinct/rows per column (4 dec., integer space) and the dictionary-candidate flag."""
    a = df.agg(F.count(F.lit(1)).alias("rows"))
    parts = [F.struct(F.lit(c).alias("column"), _distinct(df, c).alias("distinct")) for c in cols]
    out = a.select("rows", F.explode(F.array(*parts)).alias("r")).select("rows", "r.*")
    out = out.withColumn("ratio_pct", pct_int("distinct", "rows", 2))
    return out.withColumn("dictionary_candidate", F.col("distinct") < F.col("rows") * F.lit(threshold))


#: Registers of a sketch are 2 to this power: a relative error of about 0.8 %, some 8 kB a sketch at most.
SKETCH_LG_K = 14


def column_sketches(df: DataFrame, cols: list[str], by: str = DEFAULT.period) -> DataFrame:
    """by, column, rows, sketch: what ``sketched_distinct_ratio`` needs of each period, in one pass without
    a distinct shuffle of any column. Kept as a table, a new period adds its own rows and no older row of
    the panel is read again. Columns are compared as text."""
    one = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_LG_K)).alias(f"__{i}")
                                                               for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("sketch")) for i, c in enumerate(cols)]
    return one.select(by, "rows", F.inline(F.array(*parts)))


def sketched_distinct_ratio(sketches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``column_distinct_ratio`` from the merged sketches of any periods: ``distinct`` is an estimate, the
    exact path is ``column_distinct_ratio``."""
    out = sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return out.select("rows", "column", "distinct", pct_int("distinct", "rows", 2).alias("ratio_pct"),
                      (F.col("distinct") < F.col("rows") * F.lit(threshold)).alias("dictionary_candidate"))


def measure_profile_by_period(df: DataFrame, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    return (df.groupBy(b.year, b.month)
            .agg(F.count(F.lit(1)).alias("rows"),
                 *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(f"sum_{m}") for m in measures]))


def municipality_rollup(df: DataFrame, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    """Per municipality sums plus one totals line (grouping()=1) that carries the number of
    distinct non-blank municipalities and of facilities; the totals line is there without rows too."""
    g = df.groupBy(F.col(b.municipality).alias("municipality")).agg(
        F.count(F.lit(1)).alias("facilities"), *[F.sum(F.coalesce(to_number(m), F.lit(0.0))).alias(f"sum_{m}") for m in measures])
    there = F.coalesce(F.trim("municipality") != "", F.lit(False)).cast("bigint")
    whole = lambda c: F.coalesce(c, F.lit(0.0)).try_cast("bigint")
    lines = g.select("municipality", F.lit(0).cast("tinyint").alias("is_total"), "facilities", there.alias("municipalities"),
                     *[whole(F.col(f"sum_{m}")).alias(f"sum_{m}") for m in measures])
    total = g.agg(F.lit(None).cast("string").alias("municipality"), F.lit(1).cast("tinyint").alias("is_total"),
                  F.coalesce(F.sum("facilities"), F.lit(0)).cast("bigint").alias("facilities"),
                  F.coalesce(F.sum(there), F.lit(0)).cast("bigint").alias("municipalities"),
                  *[whole(F.sum(f"sum_{m}")).alias(f"sum_{m}") for m in measures])
    return lines.unionByName(total)


def coordinates_per_group(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    return df.groupBy(b.group_name).agg(F.count(F.lit(1)).alias("points"))


def geo_bounds(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    return df.agg(F.min(b.lat).alias("min_lat"), F.max(b.lat).alias("max_lat"),
                  F.min(b.lng).alias("min_lng"), F.max(b.lng).alias("max_lng"))


def available_periods(df: DataFrame, b: Binding = DEFAULT, current_year: int | None = None,
                      extra: DataFrame | None = None) -> DataFrame:
    """year -> sorted months (text list). Month 99 skipped; a year other than ``current_year``
    is listed only if months 1-12 are all present."""
    src = df.select(F.col(b.year).cast("int").alias("year"), F.col(b.month).cast("int").alias("month"))
    if extra is not None:
        src = src.unionByName(extra.select("year", "month"))
    src = src.where(F.col("month").isNotNull() & (F.col("month") != 99) & F.col("year").isNotNull())
    g = src.groupBy("year").agg(F.sort_array(F.collect_set("month")).alias("months"))
    full = F.size(F.array_intersect(F.col("months"), F.sequence(F.lit(1), F.lit(12)))) == 12
    keep = full if current_year is None else (full | (F.col("year") == F.lit(current_year)))
    return g.where(keep).select(
        "year", F.size("months").alias("n_months"),
        F.array_join(F.transform("months", lambda x: F.lpad(x.cast("string"), 2, "0")), ",").alias("months"))


def monthly_trend(df: DataFrame, measures: list[str], start: str, end: str, b: Binding = DEFAULT) -> DataFrame:
    from ..functions.period import month_name
    src = flt.month_range_filter(df, b.month, start, end)
    return (src.groupBy(b.year, b.month)
            .agg(F.count(F.lit(1)).alias("rows"),
                 *[F.round(F.coalesce(F.sum(m), F.lit(0))).cast("bigint").alias(f"sum_{m}") for m in measures])
            .withColumn("label", month_name(b.month)))


def measure_profile_columns(df: DataFrame, measures: list[str]) -> DataFrame:
    """Per measure column: sum (numeric coercion, bad -> 0), nulls, rows with a value > 0."""
    one = df.agg(*[F.coalesce(F.sum(F.coalesce(to_number(m), F.lit(0.0))), F.lit(0.0)).try_cast("bigint").alias(f"s_{m}")
                   for m in measures],
                 *[F.count_if(to_number(m).isNull()).cast("bigint").alias(f"n_{m}") for m in measures],
                 *[F.count_if(to_number(m) > 0).cast("bigint").alias(f"p_{m}") for m in measures])
    parts = [F.struct(F.lit(m).alias("measure"), F.col(f"s_{m}").alias("total"), F.col(f"n_{m}").alias("nulls"),
                      F.col(f"p_{m}").alias("positive")) for m in measures]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def measure_profile_top_groups(df: DataFrame, measures: list[str], b: Binding = DEFAULT, k: int = 10) -> DataFrame:
    """Per measure: the ``k`` groups with the largest sum (ties by group)."""
    from .ranking import top_k_per
    g = df.groupBy(b.group_name).agg(*[F.coalesce(F.sum(F.coalesce(to_number(m), F.lit(0.0))), F.lit(0.0))
                                       .try_cast("bigint").alias(m) for m in measures])
    long = g.unpivot([b.group_name], measures, "measure", "total")
    return top_k_per(long, "measure", [F.col("total").desc(), F.col(b.group_name)], k)
