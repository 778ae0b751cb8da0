"""Latest-month and per-group reports built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..binding import DEFAULT, Binding
from ..functions.numbers import pct_int
from ..operators import filters as flt
from ..operators.dims import dim_decode


def is_latest(df: DataFrame, b: Binding = DEFAULT, mode: str = "period", as_of: int | None = None):
    """Boolean column: the row belongs to the latest period (see ``filters.latest_value``)."""
    col = b.period if mode == "period" else b.month
    cond = F.col(col).cast("int") == flt.latest_value(df, b, mode, as_of)
    if as_of is not None:
        cond = cond & (F.col(b.period) <= F.lit(as_of))
    return F.coalesce(cond, F.lit(False))


def report_by_group(df: DataFrame, dim: DataFrame, b: Binding = DEFAULT, mode: str = "period",
                    as_of: int | None = None) -> DataFrame:
    """Per group: latest-month facilities, operating, connected (strict) and % connected of
    operating; all-history sums of the three levels, their total and % of the national total.

    One scan, one conditional hash aggregate keyed by group; the national total is a window
    over the aggregated rows (one per group); names come from a size-checked broadcast
    dictionary."""
    lv = list(b.levels)
    # the latest-period flag is projected once, so its scalar subquery is planned once
    src = df.select(b.group_id, b.status, b.connectivity, *lv, is_latest(df, b, mode, as_of).alias("__latest"))
    latest = F.col("__latest")
    op = latest & flt.operating(b)
    g = (src.where(F.col(b.group_id).isNotNull())
         .groupBy(b.group_id)
         .agg(F.count_if(latest).cast("bigint").alias("facilities"),
              F.count_if(op).cast("bigint").alias("operating"),
              F.count_if(op & flt.connected_strict(b)).cast("bigint").alias("connected"),
              *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"sum_{c}") for c in lv]))
    g = g.select("*", sum((F.col(f"sum_{c}") for c in lv), F.lit(0)).cast("bigint").alias("sum_total"))
    # the national total is a window over the aggregated rows (one per group, a bounded set):
    # no second scan of the panel
    national = F.sum("sum_total").over(Window.partitionBy()).cast("bigint")
    g = g.select("*", national.alias("national_total"))
    g = g.select("*", pct_int("connected", "operating", 1).alias("pct_connected"),
                 pct_int("sum_total", "national_total", 2).alias("pct_of_national"))
    return dim_decode(g, b.group_id, dim, "group_name", "Estado_")


def state_table_totals(latest: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Totals line of the group table; % connected over *all* facilities [D4]."""
    op = flt.operating(b)
    g = latest.groupBy(b.group_id).agg(F.count(F.lit(1)).alias("facilities"),
                                       F.count_if(op).cast("bigint").alias("operating"),
                                       F.count_if(op & flt.connected_strict(b)).cast("bigint").alias("connected"))
    t = g.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("facilities", "operating", "connected")])
    return t.withColumn("pct_connected_all", pct_int("connected", "facilities", 1))


def max_min_group(latest: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Group with most / fewest distinct facilities (ties by name) and the number of groups."""
    g = latest.groupBy(b.group_name).agg(F.count_distinct(b.facility).alias("n"))
    return g.agg(F.min_by(b.group_name, F.struct(-F.col("n"), F.col(b.group_name))).alias("most_group"),
                 F.max("n").alias("most_facilities"),
                 F.min_by(b.group_name, F.struct(F.col("n"), F.col(b.group_name))).alias("least_group"),
                 F.min("n").alias("least_facilities"), F.count(F.lit(1)).alias("groups"))


def group_list_sorted(df: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Distinct non-blank group names, sorted, with row count and a 10-char normalised code."""
    from ..functions.text import norm_text
    g = (df.where(F.col(b.group_name).isNotNull() & (F.trim(b.group_name) != ""))
         .groupBy(F.col(b.group_name).alias("group_name")).agg(F.count(F.lit(1)).alias("rows")))
    return g.withColumn("code", F.substring(norm_text("group_name"), 1, 10)).orderBy("group_name")


def report_group_facilities(latest: DataFrame, group_name: str, b: Binding = DEFAULT) -> DataFrame:
    """Facilities of one group (exact name) with their address line."""
    from ..functions.text import address_line
    rows = latest.where(F.col(b.group_name) == F.lit(group_name))
    parts = [c for c in (b.neighbourhood, b.street, b.number, b.postcode) if c in latest.columns]
    return rows.select(F.col(b.facility).alias("facility"), address_line(*parts).alias("address"),
                       F.col(b.municipality).alias("municipality"), F.col(b.locality).alias("locality"))


def metric_row_projection(df: DataFrame, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    """Key, name and municipality as trimmed text ('N/D' when null) and each measure as
    int(float(v)) (truncation), bad or null -> 0."""
    from ..functions.numbers import trunc_int
    nd = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("N/D"))
    return df.select(nd(b.facility).alias("facility"), nd(b.name).alias("name"),
                     nd(b.municipality).alias("municipality"), *[trunc_int(m).alias(m) for m in measures])


#: Text columns of the coordinate table, beside clave, lat and lng.
COORDINATE_TEXTS = ("nombre", "estado", "municipio", "localidad", "situacion")


def coordinate_table(latest: DataFrame, b: Binding = DEFAULT, document: str | None = None) -> DataFrame:
    """clave, lat, lng and COORDINATE_TEXTS: the records of the coordinate document if it gives any, else
    the rows of the panel that have coordinates (rounded to 6, '' for missing text). Which one it is, is
    decided when the query runs."""
    from ..sources.json_sources import scan_coordinate_documents
    source = dict(zip(COORDINATE_TEXTS, (b.name, b.group_name, b.municipality, b.locality, b.status)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in latest.columns else F.lit("")
    rows = latest.where(F.col(b.lat).isNotNull() & F.col(b.lng).isNotNull()).select(
        text(b.facility).alias("clave"), F.round(b.lat, 6).alias("lat"), F.round(b.lng, 6).alias("lng"),
        *[text(c).alias(f) for f, c in source.items()])
    if document is None:
        return rows
    records = scan_coordinate_documents(latest.sparkSession, document, list(COORDINATE_TEXTS))
    found = records.agg(F.count(F.lit(1))).scalar()
    return records.unionByName(rows.where(found == 0))


def report_coordinates(latest: DataFrame, b: Binding = DEFAULT, document: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The coordinate table (``coordinate_table``) and its points per group."""
    t = coordinate_table(latest, b, document)
    return t, t.groupBy(F.col("estado").alias(b.group_name)).agg(F.count(F.lit(1)).alias("points"))


def report_national_summary(df: DataFrame, is_latest_col, b: Binding = DEFAULT, top: int = 5) -> DataFrame:
    """Measure summary (long form: total, nulls, % null, operating facilities with a value) plus
    the top groups by the three-level total, as one long table; groups have the total only."""
    from ..operators.aggregates import group_measure_totals, measure_summary
    ms = measure_summary(df, list(b.levels), is_latest_col, b).select(
        F.lit("measure").alias("section"), F.col("measure").alias("name"), F.col("total").alias("value"),
        "nulls", "pct_null", "operating_positive")
    g = group_measure_totals(df, b).orderBy(F.col("sum_total").desc(), F.col(b.group_id)).limit(top)
    tg = g.select(F.lit("top_group").alias("section"), F.col(b.group_id).cast("string").alias("name"),
                  F.col("sum_total").alias("value"))
    return ms.unionByName(tg, allowMissingColumns=True)


# Sections of the headline report: (metric, total column, operating column or None).
STATS_SECTIONS = (("computers", "eq_total", "eq_operan"), ("servers", "srv_total", "srv_operan"), ("tables", "mesas", None),
                  ("chairs", "sillas", None), ("shelves", "anaqueles", None), ("cert_initial", "cn_inicial", None),
                  ("cert_primary", "cn_prim", None), ("cert_secondary", "cn_sec", None), ("cert_total", "cn_total", None),
                  ("cert_issued", "certificados", None))


def report_general_stats(latest: DataFrame, b: Binding = DEFAULT) -> DataFrame:
    """Latest-month headline numbers in long form (metric, name, value): facilities, operating,
    groups, group with most / fewest facilities, best loose connectivity rate, best operating
    share, highest suspension share; then the equipment, server, furniture and certificate sums of
    the columns that the table has. Facilities are counted by distinct key, shares over distinct
    (key, status) pairs of a group; connectivity is a share of rows.

    Rows reduce to one per (group, key, status) first, and every distinct count is of one column,
    so no plan multiplies rows."""
    from ..functions.numbers import to_number
    from ..operators.filters import connected_loose
    pairs = latest.groupBy(b.group_name, b.facility, b.status).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(connected_loose(b)).cast("bigint").alias("conn"))
    g = pairs.groupBy(b.group_name).agg(
        F.count_distinct(b.facility).alias("n"), F.sum("rows").alias("rows"), F.sum("conn").alias("conn"),
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col(b.status) == b.operating_code).cast("bigint").alias("op"),
        F.count_if(F.col(b.status) == 0).cast("bigint").alias("susp"))
    g = g.select("*", pct_int("op", "pairs", 2).alias("op_pct"), pct_int("susp", "pairs", 2).alias("susp_pct"),
                 pct_int("conn", "rows", 2).alias("conn_pct"))
    name = F.col(b.group_name)

    def best(v, hi=True):
        return F.min_by(F.struct(name.alias("g"), F.col(v).cast("double").alias("v")),
                        F.struct((-F.col(v) if hi else F.col(v)), name))

    a = g.agg(F.count(F.lit(1)).alias("groups"), best("n").alias("most"), best("n", False).alias("least"),
              best("conn_pct").alias("conn"), best("op_pct").alias("opr"), best("susp_pct").alias("susp"))
    keys = pairs.groupBy(b.facility).agg(F.max(F.coalesce(F.col(b.status) == b.operating_code, F.lit(False))).alias("op")).agg(
        F.count(b.facility).alias("facilities"), F.count_if(F.col("op") & F.col(b.facility).isNotNull()).alias("operating"))

    def row(metric, nm, val):
        return F.struct(F.lit(metric).alias("metric"), nm.cast("string").alias("name"), val.cast("double").alias("value"))

    def long(one, rows):
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    out = long(keys, [row(m, F.lit(""), F.col(m)) for m in ("facilities", "operating")]).unionByName(
        long(a, [row("groups", F.lit(""), F.col("groups")),
                 *[row(m, F.col(f"{k}.g"), F.col(f"{k}.v")) for m, k in
                   (("most_facilities", "most"), ("least_facilities", "least"), ("best_connectivity_pct", "conn"),
                    ("best_operating_pct", "opr"), ("highest_suspension_pct", "susp"))]]))
    there = [s for s in STATS_SECTIONS if s[1] in latest.columns and (s[2] is None or s[2] in latest.columns)]
    if not there:
        return out
    total = lambda c: F.coalesce(F.sum(F.coalesce(to_number(c), F.lit(0.0))), F.lit(0.0))
    sums = latest.agg(*[total(t).alias(f"{m}_total") for m, t, _ in there], *[total(o).alias(f"{m}_operating") for m, _, o in there if o])
    rows = [row(f"{m}_total", F.lit(""), F.col(f"{m}_total")) for m, _, _ in there]
    for m, _, o in there:
        if o:
            rows += [row(f"{m}_operating", F.lit(""), F.col(f"{m}_operating")),
                     row(f"{m}_operating_pct", F.lit(""), pct_int(F.col(f"{m}_operating").try_cast("bigint"), F.col(f"{m}_total").try_cast("bigint"), 2))]
    return out.unionByName(long(sums, rows))


def report_group_detail(latest: DataFrame, group_name: str, measures: list[str], b: Binding = DEFAULT) -> DataFrame:
    """Facility rows of one group (text 'N/D' when missing, measures as truncated ints), each
    with its municipality's totals (from the municipality rollup, one row per municipality)
    and, per measure, whether the facility leads the group (largest value, ties by key)."""
    from ..functions.numbers import trunc_int
    from ..operators.aggregates import municipality_rollup
    from ..operators.ranking import leader_per_measure
    rows = latest.where(F.col(b.group_name) == F.lit(group_name))
    nd = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("N/D"))
    fac = rows.select(nd(b.facility).alias("facility"), nd(b.name).alias("name"),
                      F.col(b.municipality).alias("municipality"), *[trunc_int(m).alias(m) for m in measures])
    muni = (municipality_rollup(rows, measures, b).where(F.col("is_total") == 0)
            .select("municipality", F.col("facilities").alias("muni_facilities"),
                    *[F.col(f"sum_{m}").alias(f"muni_sum_{m}") for m in measures]))
    leaders = leader_per_measure(rows.withColumn(b.facility, nd(b.facility)), measures, b)
    flags = [F.coalesce(F.col("facility") == leaders.where(F.col("measure") == m).select("leader").scalar(),
                        F.lit(False)).alias(f"leads_{m}") for m in measures]
    return fac.join(muni, "municipality", "left").select("*", *flags)
