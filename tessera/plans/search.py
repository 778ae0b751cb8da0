"""Text search over the latest month: substring, scored, merged; and the facility report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.geo import map_search_url
from ..functions.text import address_line, match_score, match_type, norm_text, norm_text_lit
from ..operators import filters as flt
from ..operators.image_index import ImageIndex, images_of_key
from ..operators.ranking import first_per_key


def search_global(latest: DataFrame, query: str, b: Binding = DEFAULT, limit: int = 20) -> DataFrame:
    """Case-insensitive substring over key, group, municipality, locality, neighbourhood and
    street; one row per key (first by key order); the first ``limit`` keys."""
    cols = [b.facility, b.group_name, b.municipality, b.locality, b.neighbourhood, b.street]
    hits = flt.multi_column_contains(latest, query, cols)
    keep = [c for c in (b.facility, b.group_name, b.municipality, b.neighbourhood, b.street, b.number, b.postcode)
            if c in latest.columns]
    one = first_per_key(hits.select(*keep), b.facility, [c for c in keep if c != b.facility])
    parts = [c for c in (b.neighbourhood, b.street, b.number, b.postcode) if c in one.columns]
    return (one.select(F.col(b.facility).alias("facility"), F.col(b.group_name).alias("group_name"),
                       F.col(b.municipality).alias("municipality"), address_line(*parts).alias("address"))
            .orderBy("facility").limit(limit))


def search_scored(latest: DataFrame, query: str, b: Binding = DEFAULT, kind: str = "todas",
                  limit: int = 20) -> DataFrame:
    """First matching rule per row (exact key 100 ... name 50), accent-insensitive; optional
    match-type filter; best score first, ties by key."""
    short = len((query or "").strip()) < 2  # too short: no rows, the same columns
    mt = match_type((query or "").strip(), b.facility, b.group_name, b.municipality, b.locality, b.name)
    s = latest.select(F.col(b.facility).alias("facility"), F.col(b.name).alias("name"),
                      F.col(b.group_name).alias("group_name"), F.col(b.municipality).alias("municipality"),
                      F.col(b.locality).alias("locality"), mt.alias("match_type"))
    s = s.where(F.lit(False) if short else F.col("match_type").isNotNull())
    if kind != "todas":
        s = s.where(F.col("match_type") == kind)
    return (s.withColumn("score", match_score(F.col("match_type")))
            .orderBy(F.col("score").desc(), F.col("facility"), F.col("name")).limit(limit))


def merge_search_results(local: DataFrame, backend: DataFrame, key: str = "facility", limit: int = 15) -> DataFrame:
    """Local hits, then backend hits whose key is new; the first ``limit`` in that order."""
    l = local.select(key, F.lit(0).alias("src"))
    r = backend.select(key).join(local.select(key), key, "left_anti").select(key, F.lit(1).alias("src"))
    return l.unionByName(r).orderBy("src", key).limit(limit)


def group_name_search(df: DataFrame, query: str, b: Binding = DEFAULT) -> DataFrame:
    """Distinct group names containing ``query`` (accent/case-insensitive), exact matches first."""
    q = F.lit(norm_text_lit(query))
    n = df.select(F.col(b.group_name).alias("group_name")).distinct()
    n = n.where(norm_text("group_name").contains(q))
    return n.withColumn("exact", norm_text("group_name") == q).orderBy(F.col("exact").desc(), "group_name")


def facility_history(df: DataFrame, key: str, b: Binding = DEFAULT, measures=("cn_total",)) -> DataFrame:
    """All periods of one key, newest first."""
    h = flt.facility_by_key(df, key, b)
    num = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double").try_cast("int"), F.lit(0))
    return (h.select(F.col(b.facility).alias("facility"), num(b.year).alias("year"),
                     num(b.month).alias("month"), F.col(b.status).alias("status"), *measures)
            .orderBy(F.col("year").desc(), F.col("month").desc()))


def report_facility(df: DataFrame, latest: DataFrame, key: str, b: Binding = DEFAULT,
                    images: ImageIndex | None = None) -> DataFrame:
    """Profile of one key in the latest month: identity and location fields, address, map link;
    ``profile``, a struct per category of the fields that the table has; ``history``, its periods
    newest first (period, status, cn_total); ``images``, its files in the catalogue by file id.
    The lists belong to one facility: one entry per period, and per file of its folder."""
    from ..operators.schema import PROFILE_CATEGORIES, facility_profile_struct
    row = first_per_key(flt.facility_by_key(latest, key, b), b.facility, [b.period])
    categories = [c for c, fields in PROFILE_CATEGORIES if any(f in row.columns for f in fields)]
    profiled = facility_profile_struct(row.select("*")).select(F.struct(*categories).alias("profile"))
    past = [c for c in (b.period, b.status, "cn_total") if c in df.columns]
    hist = flt.facility_by_key(df, key, b).agg(F.reverse(F.array_sort(F.collect_list(F.struct(*past)))).alias("h")).scalar()
    files = F.array()
    if images is not None:
        files = images_of_key(images, key).agg(F.array_sort(F.collect_list(F.struct("file_id", "file_name", "url")))).scalar()
    parts = [c for c in (b.neighbourhood, b.street, b.number, b.postcode) if c in row.columns]
    return row.select(
        F.col(b.facility).alias("facility"), F.col(b.name).alias("name"),
        F.col(b.group_name).alias("group_name"), F.col(b.zone).alias("zone"),
        F.col(b.municipality).alias("municipality"), F.col(b.locality).alias("locality"),
        F.col(b.period).alias("period"), F.col(b.status).alias("status"),
        address_line(*parts).alias("address"),
        F.when(F.col(b.lat).isNotNull() & F.col(b.lng).isNotNull() & (F.col(b.lat) != 0) & (F.col(b.lng) != 0),
               map_search_url(b.lat, b.lng)).alias("map_url"),
        profiled.scalar().alias("profile"), hist.alias("history"), files.alias("images"))
