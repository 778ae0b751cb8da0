"""Row filters and predicates over a panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..binding import DEFAULT, Binding
from ..functions.text import norm_text, norm_text_lit, or_contains
from ..sources.tables import partition_values


def latest_value(df: DataFrame, b: Binding = DEFAULT, mode: str = "period", as_of: int | None = None) -> Column:
    """The newest period (mode ``period``: year*100+month) or the highest month number ignoring the year
    (mode ``month``, the reference's behaviour). ``as_of`` caps the period considered.

    Of a table partitioned by period, the newest period is a value of its file listing (writers leave no
    empty partitions); no row is read for it and it prunes partitions as a literal. Of anything else it is
    a scalar subquery, evaluated once."""
    if mode == "period":
        values = partition_values(df, b.period)
        if values is not None and all(isinstance(v, int) for v in values):
            return F.lit(max((v for v in values if as_of is None or v <= as_of), default=None)).cast("int")
    src = df
    if as_of is not None:
        src = src.where(F.col(b.period) <= F.lit(as_of))
    col = b.period if mode == "period" else b.month
    return src.select(F.max(F.col(col).cast("int"))).scalar()


def latest_period_filter(df: DataFrame, b: Binding = DEFAULT, mode: str = "period",
                         as_of: int | None = None) -> DataFrame:
    """Rows of the latest period (see ``latest_value``). ``as_of`` also bounds the rows kept."""
    src = df if as_of is None else df.where(F.col(b.period) <= F.lit(as_of))
    col = b.period if mode == "period" else b.month
    return src.where(F.col(col).cast("int") == latest_value(df, b, mode, as_of))


def cascade_filter(df: DataFrame, levels: dict[str, str | None]) -> DataFrame:
    """AND of equalities on normalised columns; empty value = no filter; unknown column -> empty."""
    out = df
    for colname, v in levels.items():
        if v is None or str(v).strip() == "":
            continue
        if colname not in df.columns:
            return df.where(F.lit(False))
        out = out.where(norm_text(colname) == F.lit(norm_text_lit(str(v))))
    return out


def facility_by_key(df: DataFrame, key: str, b: Binding = DEFAULT) -> DataFrame:
    return df.where(norm_text(b.facility) == F.lit(norm_text_lit(key)))


def filter_group_status(df: DataFrame, group: int, status: int, b: Binding = DEFAULT) -> DataFrame:
    """Group and/or status equality, -1 = any; nulls never match a given value."""
    out = df
    if group >= 0:
        out = out.where(F.col(b.group_id) == F.lit(group))
    if status >= 0:
        out = out.where(F.col(b.status) == F.lit(status))
    return out


# Operating status text, and the two truthiness lists for connectivity.
OPERATING_TEXT = "EN OPERACIÓN"
NOT_CONNECTED_STRICT = ("nan", "none", "0", "false", "no", "")
NOT_CONNECTED_LOOSE = ("", "nan", "na", "none", "null", "0")


def operating(b: Binding = DEFAULT, textual: bool = False) -> Column:
    c = F.col(b.status)
    if textual:
        return F.coalesce(F.upper(F.trim(c.cast("string"))) == F.lit(OPERATING_TEXT), F.lit(False))
    return F.coalesce(c == F.lit(b.operating_code), F.lit(False))


def connected_strict(b: Binding = DEFAULT) -> Column:
    t = F.lower(F.trim(F.col(b.connectivity).cast("string")))
    return F.coalesce(~t.isin(*NOT_CONNECTED_STRICT), F.lit(False))


def connected_loose(b: Binding = DEFAULT) -> Column:
    t = F.lower(F.trim(F.col(b.connectivity).cast("string")))
    return F.coalesce(~t.isin(*NOT_CONNECTED_LOOSE), F.lit(False))


def positive_measure_filter(df: DataFrame, measure: str, b: Binding = DEFAULT) -> DataFrame:
    return df.where(operating(b) & (F.coalesce(F.col(measure), F.lit(0)) > 0))


def multi_column_contains(df: DataFrame, query: str, cols: list[str]) -> DataFrame:
    """Case-insensitive literal substring over the given columns; query under 2 chars -> empty."""
    q = (query or "").strip().lower()
    if len(q) < 2:
        return df.where(F.lit(False))
    present = [c for c in cols if c in df.columns]
    if not present:
        return df.where(F.lit(False))
    return df.where(or_contains(present, q))


def concat_index_contains(df: DataFrame, query: str, cols: list[str], sep: str = "|") -> DataFrame:
    q = (query or "").strip().lower()
    idx = F.lower(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df.where(idx.contains(F.lit(q)))


def month_range_filter(df: DataFrame, month_col: str, start: str, end: str) -> DataFrame:
    """start <= MM <= end on two-digit month strings."""
    mm = F.lpad(F.col(month_col).cast("string"), 2, "0")
    return df.where(mm.between(F.lit(start), F.lit(end)))


def near_point_box(df: DataFrame, lat: float, lng: float, b: Binding = DEFAULT, eps: float = 1e-4) -> DataFrame:
    return df.where((F.abs(F.col(b.lat) - F.lit(lat)) < eps) & (F.abs(F.col(b.lng) - F.lit(lng)) < eps))


def drop_incomplete_hierarchy(df: DataFrame, cols: list[str]) -> DataFrame:
    ok = reduce(lambda a, c: a & c,
                [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in cols])
    return df.where(ok)


def key_pattern_query(df: DataFrame, pattern: str, b: Binding = DEFAULT) -> DataFrame:
    return df.where(F.coalesce(F.col(b.facility), F.lit("")).rlike(pattern))
