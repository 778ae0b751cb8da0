"""Registered queries over the driver's tables: Spark plan + DuckDB oracle text per id.

Each entry binds an operator of the library to the panel derived from the test tables
(``sources.testbind``). ``QUERIES`` maps id -> (spark_fn, oracle_sql or None).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..binding import DEFAULT as B
from ..operators.dims import as_dim
from ..sources.tables import bounded_broadcast, table
from ..sources.testbind import oracle, panel
from . import reports


QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared scratch folder."""
    import uuid
    from ..session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _nation_dim(spark: SparkSession, sf: str) -> DataFrame:
    return as_dim(table(spark, sf, "nation"), "n_nationkey", "n_name")


# ---------------------------------------------------------------------------------- reports
LATEST_SQL = "(SELECT max(period_key) FROM panel)"


def _pct(num: str, den: str, scale: int = 2) -> str:
    from ..functions.numbers import pct_int_sql
    return pct_int_sql(num, den, scale)


@register("report_by_group", oracle(f"""
, g AS (
  SELECT estado_id,
         CAST(SUM(CASE WHEN period_key = {LATEST_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS facilities,
         CAST(SUM(CASE WHEN period_key = {LATEST_SQL} AND situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating,
         CAST(SUM(CASE WHEN period_key = {LATEST_SQL} AND situacion = 1
                        AND lower(trim(conectividad)) NOT IN ('nan','none','0','false','no','') THEN 1 ELSE 0 END) AS BIGINT) AS connected,
         CAST(COALESCE(SUM(cn_inicial), 0) AS BIGINT) AS sum_cn_inicial,
         CAST(COALESCE(SUM(cn_prim), 0) AS BIGINT) AS sum_cn_prim,
         CAST(COALESCE(SUM(cn_sec), 0) AS BIGINT) AS sum_cn_sec
  FROM panel WHERE estado_id IS NOT NULL GROUP BY estado_id),
t AS (SELECT *, CAST(sum_cn_inicial + sum_cn_prim + sum_cn_sec AS BIGINT) AS sum_total FROM g),
nat AS (SELECT CAST(SUM(sum_total) AS BIGINT) AS n FROM t)
SELECT t.*, {_pct('connected', 'operating', 1)} AS pct_connected,
       {_pct('sum_total', '(SELECT n FROM nat)', 2)} AS pct_of_national,
       (SELECT n FROM nat) AS national_total,
       COALESCE(nation.n_name, 'Estado_' || CAST(t.estado_id AS VARCHAR)) AS group_name
FROM t LEFT JOIN nation ON nation.n_nationkey = t.estado_id
"""))
def q_report_by_group(spark, sf):
    return reports.report_by_group(panel(spark, sf), _nation_dim(spark, sf), B)


# ------------------------------------------------------------------------ shared pieces
from pyspark.sql import functions as F  # noqa: E402

from ..functions import geo, numbers as nb, period as pe, text as tx  # noqa: E402
from ..operators import aggregates as ag, dims, filters as flt, ranking as rk  # noqa: E402
from ..operators.dims import STATES, STATUSES  # noqa: E402


def _latest(spark, sf):
    return flt.latest_period_filter(panel(spark, sf), B)


def _first_group(spark, sf):
    """The first group that has rows in the latest period, as a scalar subquery."""
    return _latest(spark, sf).agg(F.min("estado")).scalar()


def ol(sql: str) -> str:
    """Oracle with a ``latest`` CTE (rows of the latest period)."""
    return oracle(f", latest AS (SELECT * FROM panel WHERE period_key = {LATEST_SQL})\n{sql}")


def _values(pairs, a: str, b: str) -> str:
    rows = ", ".join(f"({i}, '{n}')" for i, n in pairs)
    return f"(SELECT * FROM (VALUES {rows}) AS v({a}, {b}))"


STATES_SQL = _values(STATES, "dim_id", "dim_name")
STATUSES_SQL = _values(STATUSES, "dim_id", "dim_name")


def _norm_sql(x: str) -> str:
    return f"COALESCE(upper(trim(replace(strip_accents(CAST({x} AS VARCHAR)), 'ß', 'ss'))), '')"


# ---------------------------------------------------------------------- scans / sources
@register("scan_panel_pruned", oracle("SELECT clave, estado_id, cn_total FROM panel"))
def q_scan_panel_pruned(spark, sf):
    from ..sources.panel import scan_pruned
    df, missing = scan_pruned(panel(spark, sf), ["clave", "estado_id", "cn_total", "no_such_column"])
    assert missing == ["no_such_column"]
    return df


@register("scan_panel_full", oracle("SELECT * FROM panel"))
def q_scan_panel_full(spark, sf):
    return panel(spark, sf)


@register("period_source_union", oracle("""
, u AS (SELECT period_key, 'local' AS source FROM panel WHERE period_key >= 200001
        UNION ALL
        SELECT period_key, 'history' AS source FROM panel
        WHERE period_key NOT IN (SELECT DISTINCT period_key FROM panel WHERE period_key >= 200001))
SELECT period_key, source, COUNT(*) AS rows FROM u GROUP BY period_key, source"""))
def q_period_source_union(spark, sf):
    from ..sources.panel import period_source_union
    p = panel(spark, sf)
    u = period_source_union(p.where(F.col("period_key") >= 200001), p, "period_key")
    return u.groupBy("period_key", "source").agg(F.count(F.lit(1)).alias("rows"))


# ----------------------------------------------------------------------------- filters
@register("latest_period_filter", ol("SELECT clave, period_key, cn_total FROM latest"))
def q_latest_period_filter(spark, sf):
    return _latest(spark, sf).select("clave", "period_key", "cn_total")


@register("latest_period_filter_as_of", oracle(
    "SELECT clave, period_key, cn_total FROM panel WHERE period_key = (SELECT max(period_key) FROM panel WHERE period_key <= 199912)"))
def q_latest_period_filter_as_of(spark, sf):
    return flt.latest_period_filter(panel(spark, sf), B, as_of=199912).select("clave", "period_key", "cn_total")


@register("latest_period_filter_month", oracle(
    "SELECT clave, period_key, cn_total FROM panel WHERE mes = (SELECT max(mes) FROM panel)"))
def q_latest_period_filter_month(spark, sf):
    return flt.latest_period_filter(panel(spark, sf), B, mode="month").select("clave", "period_key", "cn_total")


@register("cascade_filter", oracle(f"""
SELECT clave, period_key FROM panel
WHERE {_norm_sql('zona')} = 'AMERICA' AND {_norm_sql('municipio')} = 'MAQUINAS'"""))
def q_cascade_filter(spark, sf):
    return flt.cascade_filter(panel(spark, sf), {"zona": "america", "estado": "", "municipio": " máquinas",
                                                 "localidad": None}).select("clave", "period_key")


@register("facility_by_key", oracle(f"SELECT clave, period_key, cn_total FROM panel WHERE {_norm_sql('clave')} = 'I-01-012-65'"))
def q_facility_by_key(spark, sf):
    return flt.facility_by_key(panel(spark, sf), "i-01-012-65", B).select("clave", "period_key", "cn_total")


@register("rows_by_group_exact", ol("SELECT clave, estado FROM latest WHERE estado = (SELECT min(estado) FROM latest)"))
def q_rows_by_group_exact(spark, sf):
    return _latest(spark, sf).where(F.col("estado") == _first_group(spark, sf)).select("clave", "estado")


@register("filter_group_status", oracle("SELECT clave, period_key FROM panel WHERE estado_id = 3 AND situacion = 1"))
def q_filter_group_status(spark, sf):
    return (flt.filter_group_status(panel(spark, sf), 3, 1, B).select("clave", "period_key")
            .orderBy("clave", "period_key"))


STRICT_SQL = "COALESCE(lower(trim(conectividad)) NOT IN ('nan','none','0','false','no',''), false)"
LOOSE_SQL = "COALESCE(lower(trim(conectividad)) NOT IN ('','nan','na','none','null','0'), false)"


@register("operating_predicate", oracle("SELECT clave, period_key, COALESCE(situacion = 1, false) AS operating FROM panel"))
def q_operating_predicate(spark, sf):
    return panel(spark, sf).select("clave", "period_key", flt.operating(B).alias("operating"))


@register("connected_predicate_strict", oracle(f"SELECT clave, period_key, {STRICT_SQL} AS connected FROM panel"))
def q_connected_strict(spark, sf):
    return panel(spark, sf).select("clave", "period_key", flt.connected_strict(B).alias("connected"))


@register("connected_predicate_loose", oracle(f"SELECT clave, period_key, {LOOSE_SQL} AS connected FROM panel"))
def q_connected_loose(spark, sf):
    return panel(spark, sf).select("clave", "period_key", flt.connected_loose(B).alias("connected"))


@register("positive_measure_filter", oracle(
    "SELECT clave, period_key, cn_inicial FROM panel WHERE situacion = 1 AND COALESCE(cn_inicial, 0) > 0"))
def q_positive_measure_filter(spark, sf):
    return flt.positive_measure_filter(panel(spark, sf), "cn_inicial", B).select("clave", "period_key", "cn_inicial")


@register("multi_column_contains", ol("""
SELECT clave, municipio FROM latest
WHERE contains(lower(COALESCE(clave,'')), 'quinas') OR contains(lower(COALESCE(estado,'')), 'quinas')
   OR contains(lower(COALESCE(municipio,'')), 'quinas') OR contains(lower(COALESCE(localidad,'')), 'quinas')"""))
def q_multi_column_contains(spark, sf):
    return flt.multi_column_contains(_latest(spark, sf), "QUINAS ",
                                     ["clave", "estado", "municipio", "localidad", "colonia", "calle"]
                                     ).select("clave", "municipio")


@register("concat_index_contains", ol("""
SELECT clave FROM latest
WHERE contains(lower(concat_ws('|', COALESCE(clave,''), COALESCE(nombre,''), COALESCE(estado,''),
                                    COALESCE(municipio,''), COALESCE(localidad,''))), 'nation_2|')"""))
def q_concat_index_contains(spark, sf):
    return flt.concat_index_contains(_latest(spark, sf), "nation_2|",
                                     ["clave", "nombre", "estado", "municipio", "localidad"]).select("clave")


@register("list_filter_contains", ol(f"""
SELECT clave, municipio, localidad FROM latest
WHERE contains(lower(concat_ws(' ', COALESCE(clave,''), COALESCE(municipio,''), COALESCE(localidad,''),
                                    COALESCE(nombre,''))), 'l3')"""))
def q_list_filter_contains(spark, sf):
    return flt.concat_index_contains(_latest(spark, sf), "L3", ["clave", "municipio", "localidad", "nombre"],
                                     sep=" ").select("clave", "municipio", "localidad")


@register("group_name_search", oracle(f"""
SELECT estado AS group_name, {_norm_sql('estado')} = 'NATION_1' AS exact
FROM (SELECT DISTINCT estado FROM panel) WHERE contains({_norm_sql('estado')}, 'NATION_1')"""))
def q_group_name_search(spark, sf):
    from .search import group_name_search
    return group_name_search(panel(spark, sf), "nation_1", B)


@register("key_pattern_query", ol("""
SELECT COALESCE(clave, '') AS clave, COALESCE(nombre, '') AS nombre FROM latest
WHERE regexp_matches(COALESCE(clave, ''), '^I-0[1-3]-00') ORDER BY clave LIMIT 100"""))
def q_key_pattern_query(spark, sf):
    return (flt.key_pattern_query(_latest(spark, sf), "^I-0[1-3]-00", B)
            .select(F.coalesce("clave", F.lit("")).alias("clave"), F.coalesce("nombre", F.lit("")).alias("nombre"))
            .orderBy("clave").limit(100))


@register("month_range_filter", oracle("SELECT clave, period_key FROM panel WHERE lpad(CAST(mes AS VARCHAR), 2, '0') BETWEEN '03' AND '06'"))
def q_month_range_filter(spark, sf):
    return flt.month_range_filter(panel(spark, sf), "mes", "03", "06").select("clave", "period_key")


@register("near_point_box", oracle("SELECT clave, period_key FROM panel WHERE abs(lat - 14.759) < 0.0001 AND abs(lng - -118.073) < 0.0001"))
def q_near_point_box(spark, sf):
    return flt.near_point_box(panel(spark, sf), 14.759, -118.073, B).select("clave", "period_key")


@register("drop_incomplete_hierarchy", oracle("""
SELECT clave, period_key FROM panel
WHERE COALESCE(trim(estado) <> '', false) AND COALESCE(trim(zona) <> '', false) AND COALESCE(trim(municipio) <> '', false)
  AND COALESCE(trim(localidad) <> '', false) AND COALESCE(trim(clave) <> '', false) AND COALESCE(trim(conectividad) <> '', false)"""))
def q_drop_incomplete_hierarchy(spark, sf):
    return flt.drop_incomplete_hierarchy(panel(spark, sf), B.hierarchy() + ["conectividad"]).select("clave", "period_key")


# ----------------------------------------------------------------------------- scalars
SAFE_NUM_SQL = "TRY_CAST(regexp_replace(trim(inc_total_raw), '[^0-9.\\-]', '', 'g') AS DOUBLE)"


@register("norm_text", oracle(f"""
SELECT clave, period_key, {_norm_sql('municipio')} AS municipio_norm, {_norm_sql('estado')} AS estado_norm,
       {_norm_sql('conectividad')} AS conectividad_norm FROM panel"""))
def q_norm_text(spark, sf):
    return panel(spark, sf).select("clave", "period_key", tx.norm_text("municipio").alias("municipio_norm"),
                                   tx.norm_text("estado").alias("estado_norm"),
                                   tx.norm_text("conectividad").alias("conectividad_norm"))


@register("norm_text_documents", oracle(f"SELECT doc_id, md5({_norm_sql('text')}) AS text_norm_md5 FROM documents"))
def q_norm_text_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.norm_text("text")).alias("text_norm_md5"))


@register("norm_header", oracle("""
SELECT clave, period_key,
       lower(trim(regexp_replace(replace(strip_accents(municipio), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS municipio_header
FROM panel"""))
def q_norm_header(spark, sf):
    return panel(spark, sf).select("clave", "period_key", tx.norm_header("municipio").alias("municipio_header"))


@register("safe_int", oracle(f"""
SELECT clave, period_key, COALESCE(TRY_CAST(round_even({SAFE_NUM_SQL}, 0) AS BIGINT), 0) AS inc_total_int FROM panel"""))
def q_safe_int(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.safe_int("inc_total_raw").alias("inc_total_int"))


@register("safe_float", oracle(f"SELECT clave, period_key, COALESCE({SAFE_NUM_SQL}, 0.0) AS inc_total_float FROM panel"))
def q_safe_float(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.safe_float("inc_total_raw").alias("inc_total_float"))


@register("safe_string", oracle("""
SELECT clave, period_key, COALESCE(trim(conectividad), '') AS conect_safe,
       CASE WHEN lower(COALESCE(trim(conectividad), '')) IN ('nan','none','nat') THEN '' ELSE COALESCE(trim(conectividad), '') END AS conect_clean
FROM panel"""))
def q_safe_string(spark, sf):
    return panel(spark, sf).select("clave", "period_key", tx.safe_string("conectividad").alias("conect_safe"),
                                   tx.clean_string("conectividad").alias("conect_clean"))


@register("to_numeric_coerce", oracle("SELECT clave, period_key, TRY_CAST(inc_total_raw AS DOUBLE) AS inc_total_num FROM panel"))
def q_to_numeric(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.to_number("inc_total_raw").alias("inc_total_num"))


@register("coalesce_field", oracle("SELECT clave, period_key, COALESCE(conectividad, 'N/D') AS conectividad FROM panel"))
def q_coalesce_field(spark, sf):
    return panel(spark, sf).select("clave", "period_key", tx.coalesce_field("conectividad", "N/D").alias("conectividad"))


@register("clamp_month", oracle("""
SELECT clave, period_key, CAST(trunc(greatest(1.0, least(12.0, COALESCE(TRY_CAST(inc_total_raw AS DOUBLE), 1.0)))) AS INTEGER) AS month_clamped,
       CAST(trunc(greatest(1.0, least(12.0, COALESCE(TRY_CAST(CAST(mes - 3 AS VARCHAR) AS DOUBLE), 1.0)))) AS INTEGER) AS mes_clamped
FROM panel"""))
def q_clamp_month(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.clamp_month("inc_total_raw").alias("month_clamped"),
                                   nb.clamp_month((F.col("mes") - 3).cast("string")).alias("mes_clamped"))


@register("safe_year", oracle("""
SELECT clave, period_key, COALESCE(CAST(trunc(TRY_CAST(CAST(anio AS VARCHAR) AS DOUBLE)) AS INTEGER), 0) AS year_safe,
       COALESCE(CAST(trunc(TRY_CAST(inc_total_raw AS DOUBLE)) AS INTEGER), 0) AS raw_year FROM panel"""))
def q_safe_year(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.safe_year(F.col("anio").cast("string")).alias("year_safe"),
                                   nb.safe_year("inc_total_raw").alias("raw_year"))


@register("period_key", oracle("""
SELECT clave, period_key,
       CASE WHEN anio % 100 < 100 THEN (anio % 100 + 2000) ELSE anio % 100 END * 100 + mes AS pk_short_year,
       CAST(period_key // 100 AS INTEGER) AS year_back, lpad(CAST(period_key % 100 AS VARCHAR), 2, '0') AS month_back
FROM panel"""))
def q_period_key(spark, sf):
    p = panel(spark, sf)
    y, m = pe.parse_period_key("period_key")
    return p.select("clave", "period_key", pe.period_key(F.col("anio") % 100, "mes").alias("pk_short_year"),
                    y.alias("year_back"), m.alias("month_back"))


@register("period_label", oracle(f"""
SELECT clave, period_key, {pe.period_label_sql('anio', 'mes')} AS label, {pe.month_name_sql('mes + 1')} AS next_month_name
FROM panel"""))
def q_period_label(spark, sf):
    return panel(spark, sf).select("clave", "period_key", pe.period_label("anio", "mes").alias("label"),
                                   pe.month_name(F.col("mes") + 1).alias("next_month_name"))


@register("encode_status", oracle(f"""
SELECT p.clave, p.period_key, s.dim_name AS status_text,
       CASE WHEN contains(upper(s.dim_name), 'OPERACIÓN') THEN 1 ELSE 0 END AS status_code
FROM panel p JOIN {STATUSES_SQL} s ON s.dim_id = p.situacion"""))
def q_encode_status(spark, sf):
    from ..operators.clean import encode_status
    p = dims.dim_decode(panel(spark, sf), "situacion", dims.statuses_dim(spark), "status_text", "Situación_")
    return p.select("clave", "period_key", "status_text", encode_status("status_text").alias("status_code"))


@register("parse_decimal_comma", oracle("""
SELECT clave, period_key, TRY_CAST(replace(trim(replace(CAST(lat AS VARCHAR), '.', ',')), ',', '.') AS DOUBLE) AS lat_parsed FROM panel"""))
def q_parse_decimal_comma(spark, sf):
    raw = F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(","))
    return panel(spark, sf).select("clave", "period_key", nb.parse_decimal_comma(raw).alias("lat_parsed"))


HAV_SQL = geo.haversine_sql("lat", "lng", "19.4326", "-99.1332")


@register("haversine_km", oracle(f"SELECT clave, period_key, round({HAV_SQL}, 6) AS km FROM panel"))
def q_haversine(spark, sf):
    return panel(spark, sf).select("clave", "period_key",
                                   F.round(geo.haversine_km("lat", "lng", F.lit(19.4326), F.lit(-99.1332)), 6).alias("km"))


@register("pair_distance", oracle(f"""
SELECT clave, period_key, round({HAV_SQL}, 2) AS km, CAST(round({HAV_SQL} * 1000) AS BIGINT) AS metres,
       printf('%.1f km', {HAV_SQL}) AS km_text
FROM panel"""))
def q_pair_distance(spark, sf):
    d = geo.haversine_km("lat", "lng", F.lit(19.4326), F.lit(-99.1332))
    return (panel(spark, sf)
            .select("clave", "period_key", F.round(d, 2).alias("km"), F.round(d * 1000).cast("bigint").alias("metres"),
                    geo.distance_text(d).alias("km_text")))


@register("travel_time_text", oracle(f"""
SELECT clave, period_key,
       CASE WHEN CAST(floor({HAV_SQL} / 40) AS BIGINT) > 0
            THEN printf('%dh %dmin', CAST(floor({HAV_SQL} / 40) AS BIGINT), CAST(floor(({HAV_SQL} / 40 - floor({HAV_SQL} / 40)) * 60) AS BIGINT))
            ELSE printf('%d min', CAST(floor(({HAV_SQL} / 40 - floor({HAV_SQL} / 40)) * 60) AS BIGINT)) END AS eta
FROM panel"""))
def q_travel_time(spark, sf):
    d = geo.haversine_km("lat", "lng", F.lit(19.4326), F.lit(-99.1332))
    return panel(spark, sf).select("clave", "period_key", geo.travel_time_text(d).alias("eta"))


@register("interpolate_route", oracle("""
SELECT s.s_suppkey AS point_id, i AS step,
       round(p.lat + (19.4326 - p.lat) * i / 10, 9) AS lat, round(p.lng + (-99.1332 - p.lng) * i / 10, 9) AS lng
FROM (SELECT s_suppkey, CAST(14.5 AS DOUBLE) + CAST((s_suppkey * 37) % 18200 AS DOUBLE) / 1000 AS lat,
             CAST(-118.5 AS DOUBLE) + CAST((s_suppkey * 61) % 31800 AS DOUBLE) / 1000 AS lng FROM supplier) p
JOIN supplier s ON s.s_suppkey = p.s_suppkey, range(0, 11) t(i)"""))
def q_interpolate_route(spark, sf):
    from ..sources.testbind import points
    r = points(spark, sf).select("point_id", F.explode(
        geo.interpolate_route("lat", "lng", F.lit(19.4326), F.lit(-99.1332))).alias("p"))
    return r.select("point_id", F.col("p.step").cast("bigint").alias("step"), F.round("p.lat", 9).alias("lat"),
                    F.round("p.lng", 9).alias("lng"))


@register("navigation_urls", ol("""
SELECT clave,
       'https://www.google.com/maps/search/?api=1&query=' || printf('%.6f', lat) || ',' || printf('%.6f', lng) AS map_url,
       'https://www.waze.com/ul?ll=' || printf('%.6f', lat) || ',' || printf('%.6f', lng) || '&navigate=yes&to=' || replace(nombre, ' ', '+') AS waze_url,
       'https://www.google.com/maps/dir/?api=1&origin=19.4326,-99.1332&destination=' || printf('%.6f', lat) || ',' || printf('%.6f', lng)
         || '&destination_place_id=' || replace(nombre, ' ', '+') || '&travelmode=driving' AS directions_url
FROM latest"""))
def q_navigation_urls(spark, sf):
    la, ln = F.format_string("%.6f", F.col("lat")), F.format_string("%.6f", F.col("lng"))
    return _latest(spark, sf).select("clave", geo.map_search_url(la, ln).alias("map_url"),
                                     geo.waze_url(la, ln, F.col("nombre")).alias("waze_url"),
                                     geo.navigation_url(F.lit("19.4326"), F.lit("-99.1332"), la, ln, F.col("nombre"))
                                     .alias("directions_url"))


@register("address_line", oracle("""
SELECT clave, period_key, concat_ws(', ', NULLIF(trim(municipio), ''), NULLIF(trim(localidad), ''),
                                   NULLIF(trim(conectividad), ''), NULLIF(trim(zona), '')) AS address FROM panel"""))
def q_address_line(spark, sf):
    return panel(spark, sf).select("clave", "period_key",
                                   tx.address_line("municipio", "localidad", "conectividad", "zona").alias("address"))


@register("pct_change", oracle(f"""
SELECT clave, period_key, {nb.pct_int_sql('cn_prim - cn_inicial', 'cn_inicial')} AS pct,
       {nb.pct_int_sql('cn_prim - cn_inicial', 'greatest(cn_inicial, 1)')} AS pct_floor1 FROM panel"""))
def q_pct_change(spark, sf):
    return panel(spark, sf).select("clave", "period_key", nb.pct_change("cn_inicial", "cn_prim").alias("pct"),
                                   nb.pct_change_floor1("cn_inicial", "cn_prim").alias("pct_floor1"))


@register("growth_sign_label", oracle(f"""
SELECT clave, period_key,
       CASE WHEN cn_prim - cn_inicial > 0 THEN 'positive' WHEN cn_prim - cn_inicial < 0 THEN 'negative' ELSE 'neutral' END AS sign_class,
       CASE WHEN cn_prim - cn_inicial > 0 THEN '+' ELSE '' END || format('{{:,}}', cn_prim - cn_inicial) AS delta_text,
       CASE WHEN {nb.pct_int_sql('cn_prim - cn_inicial', 'cn_inicial', 2)} > 0 THEN '+' ELSE '' END
         || printf('%.2f', {nb.pct_int_sql('cn_prim - cn_inicial', 'cn_inicial', 2)}) || '%' AS pct_text,
       CASE WHEN cn_prim - cn_inicial > 0 THEN '📈' WHEN cn_prim - cn_inicial < 0 THEN '📉' ELSE '➡️' END AS trend,
       CASE WHEN cn_prim - cn_inicial > 0 THEN '📈 Aumento' WHEN cn_prim - cn_inicial < 0 THEN '📉 Disminución' ELSE '➡️ Sin cambio' END AS trend_label
FROM panel"""))
def q_growth_sign_label(spark, sf):
    from ..functions.labels import delta_text, pct_text, sign_class, trend_icon, trend_text
    d = F.col("cn_prim") - F.col("cn_inicial")
    p = nb.pct_change("cn_inicial", "cn_prim", 2)
    return panel(spark, sf).select("clave", "period_key", sign_class(d).alias("sign_class"),
                                   delta_text(d).alias("delta_text"), pct_text(p).alias("pct_text"),
                                   trend_icon(d).alias("trend"), trend_text(d).alias("trend_label"))


@register("connectivity_band", oracle(f"""
SELECT clave, period_key, CASE WHEN p < 50 THEN 'low' WHEN p < 70 THEN 'medium' ELSE 'high' END AS band
FROM (SELECT clave, period_key, {nb.pct_int_sql('cn_inicial', 'cn_total', 1)} AS p FROM panel)"""))
def q_connectivity_band(spark, sf):
    from ..functions.labels import connectivity_band
    p = nb.pct_int("cn_inicial", "cn_total", 1)
    return panel(spark, sf).select("clave", "period_key", connectivity_band(p).alias("band"))


@register("round_coordinates", oracle("SELECT clave, period_key, round(lat, 6) AS lat6, round(lng, 7) AS lng7 FROM panel"))
def q_round_coordinates(spark, sf):
    return panel(spark, sf).select("clave", "period_key", F.round("lat", 6).alias("lat6"), F.round("lng", 7).alias("lng7"))


KEY_VARIANTS_SQL = """
SELECT clave, v, variant FROM (
  SELECT clave, clave AS v, 'plain' AS variant FROM latest
  UNION ALL SELECT clave, estado || '_' || clave, 'prefixed' FROM latest
  UNION ALL SELECT clave, replace(lower(clave), 'i-', 'l- '), 'l_space' FROM latest
  UNION ALL SELECT clave, replace(clave, '-0', '-') || ' (1)', 'unpadded' FROM latest
  UNION ALL SELECT clave, nombre, 'name' FROM latest)"""


def _key_norm_sql(v: str) -> str:
    pat = tx.KEY_PATTERN
    g = [f"regexp_extract({v}, '{pat}', {i})" for i in range(5)]
    pad = lambda x, n: f"lpad({x}, CAST(greatest(length({x}), {n}) AS INTEGER), '0')"
    letter = f"CASE WHEN {g[1]} IN ('L','l','1') THEN 'I' ELSE {g[1]} END"
    key = f"concat_ws('-', {letter}, {pad(g[2], 2)}, {pad(g[3], 3)}, {pad(g[4], 2)})"
    return f"lower(CASE WHEN regexp_matches({v}, '{pat}') THEN {key} ELSE trim({v}) END)"


@register("normalise_facility_key", ol(f"""
, kv AS ({KEY_VARIANTS_SQL})
SELECT clave, variant, v AS original, {_key_norm_sql('v')} AS key FROM kv"""))
def q_normalise_facility_key(spark, sf):
    l = _latest(spark, sf)
    kv = (l.select("clave", F.col("clave").alias("v"), F.lit("plain").alias("variant"))
          .unionByName(l.select("clave", F.concat("estado", F.lit("_"), "clave").alias("v"), F.lit("prefixed").alias("variant")))
          .unionByName(l.select("clave", F.replace(F.lower("clave"), F.lit("i-"), F.lit("l- ")).alias("v"), F.lit("l_space").alias("variant")))
          .unionByName(l.select("clave", F.concat(F.replace("clave", F.lit("-0"), F.lit("-")), F.lit(" (1)")).alias("v"), F.lit("unpadded").alias("variant")))
          .unionByName(l.select("clave", F.col("nombre").alias("v"), F.lit("name").alias("variant"))))
    return kv.select("clave", "variant", F.col("v").alias("original"), tx.normalise_facility_key("v").alias("key"))


# ------------------------------------------------------------------------------ joins / dims
def _group_names_sql(x: str) -> str:
    names = ", ".join(f"'{n}'" for _, n in STATES)
    return f"[{names}][{x} + 1]"


@register("dim_decode", oracle(f"""
SELECT CASE WHEN p.estado_id IS NULL THEN '' ELSE COALESCE(g.dim_name, 'Estado_' || CAST(p.estado_id AS VARCHAR)) END AS group_label,
       CASE WHEN p.situacion IS NULL THEN '' ELSE COALESCE(s.dim_name, 'Situación_' || CAST(p.situacion AS VARCHAR)) END AS status_label,
       COUNT(*) AS rows
FROM panel p LEFT JOIN {STATES_SQL} g ON g.dim_id = p.estado_id LEFT JOIN {STATUSES_SQL} s ON s.dim_id = p.situacion
GROUP BY 1, 2"""))
def q_dim_decode(spark, sf):
    p = dims.dim_decode(panel(spark, sf), "estado_id", dims.states_dim(spark), "group_label", "Estado_")
    p = dims.dim_decode(p, "situacion", dims.statuses_dim(spark), "status_label", "Situación_")
    return p.groupBy("group_label", "status_label").agg(F.count(F.lit(1)).alias("rows"))


ENC_NAMES = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(dims.STATE_ENCODE_EXACT))


@register("dim_encode", oracle(f"""
, t AS (SELECT DISTINCT estado_id, {_group_names_sql('estado_id')} AS state_text FROM panel),
  enc AS (SELECT * FROM (VALUES {ENC_NAMES}) v(enc_id, enc_name))
SELECT t.estado_id, t.state_text,
       COALESCE((SELECT enc_id FROM enc WHERE {_norm_sql('enc.enc_name')} = {_norm_sql('t.state_text')}), 0) AS id_folded,
       COALESCE((SELECT enc_id FROM enc WHERE enc.enc_name = upper(trim(t.state_text))), 0) AS id_exact
FROM t"""))
def q_dim_encode(spark, sf):
    names = F.array(*[F.lit(n) for _, n in STATES])
    t = panel(spark, sf).select("estado_id", F.element_at(names, F.col("estado_id") + 1).alias("state_text")).distinct()
    t = dims.dim_encode(t, "state_text", "id_folded", spark, accent_insensitive=True)
    return dims.dim_encode(t, "state_text", "id_exact", spark, accent_insensitive=False)


@register("derive_dim_from_data", oracle("SELECT DISTINCT CAST(estado_id AS INTEGER) AS dim_id, trim(estado) AS dim_name FROM panel"))
def q_derive_dim(spark, sf):
    return dims.derive_dim_from_data(panel(spark, sf), "estado_id", "estado", "period_key")


@register("dim_merge_precedence", ol("""
, a AS (SELECT DISTINCT CAST(estado_id AS INTEGER) AS dim_id, lower(trim(estado)) AS dim_name FROM latest WHERE situacion = 1),
  b AS (SELECT DISTINCT CAST(estado_id AS INTEGER) AS dim_id, trim(estado) AS dim_name FROM panel)
SELECT dim_id, dim_name FROM a UNION ALL SELECT dim_id, dim_name FROM b WHERE dim_id NOT IN (SELECT dim_id FROM a)"""))
def q_dim_merge(spark, sf):
    a = dims.derive_dim_from_data(_latest(spark, sf).where("situacion = 1")
                                  .withColumn("estado", F.lower("estado")), "estado_id", "estado")
    b = dims.derive_dim_from_data(panel(spark, sf), "estado_id", "estado")
    return dims.dim_merge_precedence(a, b)


@register("canonical_group_name", oracle(f"SELECT DISTINCT estado AS group_name FROM panel WHERE {_norm_sql('estado')} = 'NATION_7'"))
def q_canonical_group_name(spark, sf):
    return dims.canonical_group_name(panel(spark, sf), "estado", " nation_7 ")


GROUP_AGG_JOIN_SQL = f"""
, h AS (SELECT estado_id, CAST(SUM(COALESCE(cn_inicial,0) + COALESCE(cn_prim,0) + COALESCE(cn_sec,0)) AS BIGINT) AS cn_history
        FROM panel GROUP BY estado_id),
  c AS (SELECT estado_id, COUNT(*) AS facilities FROM latest GROUP BY estado_id),
  o AS (SELECT estado_id, COUNT(*) AS operating FROM latest WHERE situacion = 1 GROUP BY estado_id),
  k AS (SELECT estado_id, COUNT(*) AS connected FROM latest WHERE situacion = 1 AND {STRICT_SQL} GROUP BY estado_id)
SELECT h.estado_id, h.cn_history, COALESCE(c.facilities, 0) AS facilities, COALESCE(o.operating, 0) AS operating,
       COALESCE(k.connected, 0) AS connected
FROM h LEFT JOIN c USING (estado_id) LEFT JOIN o USING (estado_id) LEFT JOIN k USING (estado_id)"""


@register("group_aggregates_join", ol(GROUP_AGG_JOIN_SQL))
def q_group_aggregates_join(spark, sf):
    p, l = panel(spark, sf), _latest(spark, sf)
    h = p.groupBy("estado_id").agg(F.sum(F.coalesce("cn_inicial", F.lit(0)) + F.coalesce("cn_prim", F.lit(0))
                                         + F.coalesce("cn_sec", F.lit(0))).cast("bigint").alias("cn_history"))
    c = l.groupBy("estado_id").agg(F.count(F.lit(1)).alias("facilities"))
    o = l.where(flt.operating(B)).groupBy("estado_id").agg(F.count(F.lit(1)).alias("operating"))
    k = l.where(flt.operating(B) & flt.connected_strict(B)).groupBy("estado_id").agg(F.count(F.lit(1)).alias("connected"))
    # the three latest-month aggregates have one row per group (bounded by the group count)
    return (h.join(c, "estado_id", "left").join(o, "estado_id", "left").join(k, "estado_id", "left")
            .na.fill(0, ["facilities", "operating", "connected"]))


def _points_sql_inner():
    from ..sources.testbind import POINTS_SQL
    return POINTS_SQL


RADIUS_SQL = f"""
, d AS (SELECT q.point_id, l.clave AS facility, {geo.haversine_sql('q.lat', 'q.lng', 'l.lat', 'l.lng')} AS km
        FROM points q, latest l WHERE l.lat IS NOT NULL AND l.lng IS NOT NULL),
  h AS (SELECT point_id, facility, round(km, 2) AS distance_km FROM d WHERE km <= 150),
  r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, facility) AS pos FROM h)
"""


def _radius_oracle(select: str) -> str:
    from ..sources.testbind import POINTS_SQL
    return oracle(f", latest AS (SELECT * FROM panel WHERE period_key = {LATEST_SQL}), points AS ({POINTS_SQL})\n"
                  + RADIUS_SQL + select)


@register("radius_join", _radius_oracle("SELECT point_id, facility, distance_km, pos FROM r WHERE pos <= 5"))
def q_radius_join(spark, sf):
    from ..operators.nearby import radius_join
    from ..sources.testbind import points
    return radius_join(points(spark, sf), _latest(spark, sf), 150.0, B, limit_per_point=5).drop("distance_km_exact")


@register("enrich_hits", _radius_oracle("""
SELECT r.point_id, r.facility, r.distance_km, l.nombre, l.estado FROM r JOIN latest l ON l.clave = r.facility WHERE pos <= 3"""))
def q_enrich_hits(spark, sf):
    from ..operators.nearby import radius_join
    from ..sources.testbind import points
    l = _latest(spark, sf)
    h = radius_join(points(spark, sf), l, 150.0, B, limit_per_point=3)
    return h.join(l.select(F.col("clave").alias("facility"), "nombre", "estado"), "facility").drop("pos", "distance_km_exact")


@register("nearest_facility", oracle(f"""
, latest AS (SELECT * FROM panel WHERE period_key = {LATEST_SQL}), points AS ({_points_sql_inner()}),
  d AS (SELECT q.point_id, l.clave AS facility, round({geo.haversine_sql('q.lat', 'q.lng', 'l.lat', 'l.lng')}, 2) AS distance_km
        FROM points q, latest l WHERE l.lat IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, facility) AS pos FROM d WHERE distance_km <= 5000)
SELECT point_id, facility, distance_km FROM r WHERE pos = 1"""))
def q_nearest_facility(spark, sf):
    from ..operators.nearby import nearest_facility
    from ..sources.testbind import points
    return nearest_facility(points(spark, sf), _latest(spark, sf), 5000.0, B)


# ------------------------------------------------------------------------------ aggregations
LV = ["cn_inicial", "cn_prim", "cn_sec"]
CM_SQL = [("cn_total", "cn_total"), ("cn_inicial", "cn_inicial"), ("cn_prim", "cn_prim"), ("cn_sec", "cn_sec"),
          ("inc_total", "inc_total"), ("aten_total", "aten_total")]


def _clamped_sql(src: str = "panel", where: str = "") -> str:
    sums = ", ".join(f"CAST(SUM(greatest(COALESCE({c}, 0), 0)) AS BIGINT) AS {o}" for o, c in CM_SQL)
    w = f"AND {where}" if where else ""
    return f"SELECT estado_id, COUNT(*) AS facilities, {sums} FROM {src} WHERE estado_id IS NOT NULL {w} GROUP BY estado_id"


@register("agg_by_group_clamped", oracle(_clamped_sql(where="situacion = 1")))
def q_agg_clamped(spark, sf):
    return ag.agg_by_group_clamped(panel(spark, sf), B, status=1)


DIRTY = B.with_(compare_measures=(("inc_total", "inc_total_raw"), ("cn_total", "cn_total")))


@register("agg_by_group_plain", oracle("""
SELECT CAST(trunc(TRY_CAST(CAST(estado_id AS VARCHAR) AS DOUBLE)) AS INTEGER) AS estado_id, COUNT(*) AS facilities,
       CAST(trunc(SUM(COALESCE(TRY_CAST(inc_total_raw AS DOUBLE), 0.0))) AS BIGINT) AS inc_total,
       CAST(trunc(SUM(COALESCE(TRY_CAST(CAST(cn_total AS VARCHAR) AS DOUBLE), 0.0))) AS BIGINT) AS cn_total
FROM panel GROUP BY 1"""))
def q_agg_plain(spark, sf):
    return ag.agg_by_group_plain(panel(spark, sf), DIRTY)


@register("agg_by_group_named", ol(f"""
, g AS ({_clamped_sql('latest')})
SELECT g.*, COALESCE(n.n_name, 'Estado_' || CAST(g.estado_id AS VARCHAR)) AS group_name
FROM g LEFT JOIN nation n ON n.n_nationkey = g.estado_id ORDER BY facilities DESC, group_name"""))
def q_agg_named(spark, sf):
    g = ag.agg_by_group_clamped(_latest(spark, sf), B)
    g = dims.dim_decode(g, "estado_id", _nation_dim(spark, sf), "group_name", "Estado_")
    return g.orderBy(F.col("facilities").desc(), "group_name")


@register("grand_totals", ol(f"""
, g AS ({_clamped_sql('latest')})
SELECT CAST(SUM(facilities) AS BIGINT) AS facilities, {", ".join(f"CAST(SUM({o}) AS BIGINT) AS {o}" for o, _ in CM_SQL)} FROM g"""))
def q_grand_totals(spark, sf):
    g = ag.agg_by_group_clamped(_latest(spark, sf), B)
    return ag.grand_totals(g, ["facilities"] + [o for o, _ in B.compare_measures])


@register("annual_accumulate", oracle(f"""
SELECT anio, estado_id, COUNT(*) AS facility_months,
       {", ".join(f"CAST(SUM(COALESCE({c}, 0)) AS BIGINT) AS {o}" for o, c in CM_SQL)}
FROM panel WHERE estado_id IS NOT NULL GROUP BY anio, estado_id"""))
def q_annual_accumulate(spark, sf):
    return ag.annual_accumulate(panel(spark, sf), B)


@register("facilities_per_group_distinct", ol("SELECT estado, COUNT(DISTINCT clave) AS facilities FROM latest GROUP BY estado"))
def q_fac_distinct(spark, sf):
    return ag.facilities_per_group_distinct(_latest(spark, sf), B)


@register("rows_per_group", oracle("SELECT estado_id, COUNT(*) AS rows FROM panel GROUP BY estado_id"))
def q_rows_per_group(spark, sf):
    return ag.rows_per_group(panel(spark, sf), B)


@register("operating_per_group", ol("SELECT estado_id, CAST(SUM(CASE WHEN situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating FROM latest GROUP BY estado_id"))
def q_operating_per_group(spark, sf):
    return ag.operating_per_group(_latest(spark, sf), B)


@register("connected_per_group", ol(f"""
SELECT estado_id, operating, connected, {nb.pct_int_sql('connected', 'operating', 1)} AS pct_connected FROM (
  SELECT estado_id, CAST(SUM(CASE WHEN situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating,
         CAST(SUM(CASE WHEN situacion = 1 AND {STRICT_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS connected
  FROM latest GROUP BY estado_id)"""))
def q_connected_per_group(spark, sf):
    return ag.connected_per_group(_latest(spark, sf), B)


@register("connectivity_rate_by_group", ol(f"""
SELECT estado, rows, connected, {nb.pct_int_sql('connected', 'rows', 2)} AS pct_connected FROM (
  SELECT estado, COUNT(*) AS rows, CAST(SUM(CASE WHEN {LOOSE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS connected
  FROM latest GROUP BY estado)"""))
def q_connectivity_rate(spark, sf):
    return ag.connectivity_rate_by_group(_latest(spark, sf), B)


@register("status_pivot", ol(f"""
SELECT estado, {", ".join(f"COUNT(DISTINCT CASE WHEN situacion = {c} THEN clave END) AS status_{c}" for c in ag.STATUS_CODES)},
       COUNT(DISTINCT CASE WHEN situacion IN (0,1,2,3,4) THEN clave || '#' || CAST(situacion AS VARCHAR) END) AS total,
       {nb.pct_int_sql('COUNT(DISTINCT CASE WHEN situacion = 1 THEN clave END)', 'COUNT(DISTINCT CASE WHEN situacion IN (0,1,2,3,4) THEN clave || chr(35) || CAST(situacion AS VARCHAR) END)', 2)} AS pct_operating,
       {nb.pct_int_sql('COUNT(DISTINCT CASE WHEN situacion = 0 THEN clave END)', 'COUNT(DISTINCT CASE WHEN situacion IN (0,1,2,3,4) THEN clave || chr(35) || CAST(situacion AS VARCHAR) END)', 2)} AS pct_suspended
FROM latest GROUP BY estado"""))
def q_status_pivot(spark, sf):
    return ag.status_pivot(_latest(spark, sf), B)


@register("status_distribution", ol(f"""
SELECT g.status, g.rows, {nb.pct_int_sql('g.rows', '(SELECT COUNT(*) FROM latest)', 2)} AS pct,
       CASE WHEN g.status IS NULL THEN 'Sin información' ELSE COALESCE(s.dim_name, 'Situación_' || CAST(g.status AS VARCHAR)) END AS status_name
FROM (SELECT situacion AS status, COUNT(*) AS rows FROM latest GROUP BY situacion) g
LEFT JOIN {STATUSES_SQL} s ON s.dim_id = g.status"""))
def q_status_distribution(spark, sf):
    return ag.status_distribution(_latest(spark, sf), B, dims.statuses_dim(spark))


def _measure_summary_sql(ms):
    parts = []
    for m in ms:
        parts.append(f"""SELECT '{m}' AS measure, COUNT(*) AS rows, CAST(SUM(CASE WHEN {m} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  CAST(COALESCE(SUM({m}), 0) AS BIGINT) AS total,
  CAST(SUM(CASE WHEN period_key = {LATEST_SQL} AND situacion = 1 AND COALESCE({m}, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS operating_positive
FROM panel""")
    tot = " + ".join(f"COALESCE(SUM({m}), 0)" for m in ms)
    parts.append(f"""SELECT 'TOTAL', COUNT(*), CAST(0 AS BIGINT), CAST({tot} AS BIGINT),
  CAST(SUM(CASE WHEN period_key = {LATEST_SQL} AND situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) FROM panel""")
    return f", u AS ({' UNION ALL '.join(parts)})\nSELECT *, {nb.pct_int_sql('nulls', 'rows', 2)} AS pct_null FROM u"


@register("measure_summary", oracle(_measure_summary_sql(LV)))
def q_measure_summary(spark, sf):
    from .reports import is_latest
    p = panel(spark, sf)
    return ag.measure_summary(p, LV, is_latest(p, B), B)


GMT_SQL = f"""
, g AS (SELECT estado_id, {", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS sum_{c}" for c in LV)} FROM panel GROUP BY estado_id),
  t AS (SELECT *, CAST(sum_cn_inicial + sum_cn_prim + sum_cn_sec AS BIGINT) AS sum_total FROM g)"""


@register("group_measure_totals", oracle(GMT_SQL + f"""
SELECT *, {nb.pct_int_sql('sum_total', '(SELECT SUM(sum_total) FROM t)', 2)} AS pct_of_national FROM t"""))
def q_group_measure_totals(spark, sf):
    return ag.group_measure_totals(panel(spark, sf), B)


@register("equipment_ratios", ol(f"""
SELECT eq_total, eq_part, {nb.pct_int_sql('eq_part', 'eq_total', 2)} AS eq_pct FROM (
  SELECT CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST(cn_total AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS eq_total,
         CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST(cn_inicial AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS eq_part
  FROM latest)"""))
def q_equipment_ratios(spark, sf):
    return ag.ratio_sums(_latest(spark, sf), "cn_total", "cn_inicial", "eq")


@register("certificate_sums", ol(f"""
SELECT {", ".join(f"CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS sum_{c}"
                  for c in LV + ["inc_total_raw", "aten_total"])} FROM latest"""))
def q_certificate_sums(spark, sf):
    return ag.coerced_sums(_latest(spark, sf), LV + ["inc_total_raw", "aten_total"])


@register("dataset_counters", oracle(f"""
SELECT COUNT(DISTINCT clave) AS facilities, COUNT(*) AS rows, COUNT(DISTINCT estado_id) AS groups,
       CAST(SUM(CASE WHEN period_key = {LATEST_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS rows_latest FROM panel"""))
def q_dataset_counters(spark, sf):
    from .reports import is_latest
    p = panel(spark, sf)
    return ag.dataset_counters(p, is_latest(p, B), B)


@register("dataset_profile", oracle("""
SELECT COUNT(*) AS rows, 21 AS columns, COUNT(DISTINCT estado_id) AS groups, COUNT(DISTINCT clave) AS facilities,
       array_to_string(list_sort(list_distinct(list(CAST(anio AS VARCHAR)))), ',') AS years,
       array_to_string(list_transform(list_sort(list_distinct(list(mes))), lambda x: CAST(x AS VARCHAR)), ',') AS months
FROM panel"""))
def q_dataset_profile(spark, sf):
    return ag.dataset_profile(panel(spark, sf), B)


DR_COLS = ["estado", "municipio", "localidad", "clave", "conectividad"]


@register("column_distinct_ratio", oracle(f"""
, a AS (SELECT COUNT(*) AS rows, {", ".join(f"COUNT(DISTINCT {c}) AS d_{c}" for c in DR_COLS)} FROM panel),
  u AS ({" UNION ALL ".join(f"SELECT rows, '{c}' AS \"column\", d_{c} AS \"distinct\" FROM a" for c in DR_COLS)})
SELECT rows, "column", "distinct", {nb.pct_int_sql('"distinct"', 'rows', 2)} AS ratio_pct, "distinct" * 2 < rows AS dictionary_candidate FROM u"""))
def q_column_distinct_ratio(spark, sf):
    return ag.column_distinct_ratio(panel(spark, sf), DR_COLS)


@register("column_distinct_sketched", None)
def q_column_distinct_sketched(spark, sf):
    """Estimates from sketches a period; tests hold them against the exact counts."""
    return ag.sketched_distinct_ratio(ag.column_sketches(panel(spark, sf), DR_COLS))


@register("measure_profile", oracle(f"""
SELECT anio, mes, COUNT(*) AS rows, {", ".join(f"CAST(COALESCE(SUM({m}), 0) AS BIGINT) AS sum_{m}" for m in LV + ["inc_total"])}
FROM panel GROUP BY anio, mes"""))
def q_measure_profile(spark, sf):
    return ag.measure_profile_by_period(panel(spark, sf), LV + ["inc_total"], B)


MUNI_MS = ["cn_inicial", "cn_prim", "cn_sec", "cn_total", "inc_total_raw", "aten_total"]


@register("municipality_rollup", ol(f"""
SELECT municipio AS municipality, CAST(GROUPING(municipio) AS INTEGER) AS is_total, COUNT(*) AS facilities,
       COUNT(DISTINCT CASE WHEN trim(municipio) <> '' THEN municipio END) AS municipalities,
       {", ".join(f"CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS sum_{m}" for m in MUNI_MS)}
FROM latest WHERE estado = (SELECT min(estado) FROM latest) GROUP BY ROLLUP (municipio)"""))
def q_municipality_rollup(spark, sf):
    r = ag.municipality_rollup(_latest(spark, sf).where(F.col("estado") == _first_group(spark, sf)), MUNI_MS, B)
    return r.withColumn("is_total", F.col("is_total").cast("int"))


@register("state_table_totals", ol(f"""
, g AS (SELECT estado_id, COUNT(*) AS facilities, CAST(SUM(CASE WHEN situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating,
               CAST(SUM(CASE WHEN situacion = 1 AND {STRICT_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS connected FROM latest GROUP BY estado_id)
SELECT CAST(SUM(facilities) AS BIGINT) AS facilities, CAST(SUM(operating) AS BIGINT) AS operating, CAST(SUM(connected) AS BIGINT) AS connected,
       {nb.pct_int_sql('SUM(connected)', 'SUM(facilities)', 1)} AS pct_connected_all FROM g"""))
def q_state_table_totals(spark, sf):
    from .reports import state_table_totals
    return state_table_totals(_latest(spark, sf), B)


VALID_COORD_SQL = "lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0 AND lat BETWEEN 14.5 AND 32.7 AND lng BETWEEN -118.5 AND -86.7"


@register("coordinates_per_group", ol(f"SELECT estado, COUNT(*) AS points FROM latest WHERE {VALID_COORD_SQL} GROUP BY estado"))
def q_coordinates_per_group(spark, sf):
    from ..operators.clean import valid_coordinates
    return ag.coordinates_per_group(_latest(spark, sf).where(valid_coordinates("lat", "lng")), B)


@register("geo_bounds", ol(f"SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng FROM latest WHERE {VALID_COORD_SQL}"))
def q_geo_bounds(spark, sf):
    from ..operators.clean import valid_coordinates
    return ag.geo_bounds(_latest(spark, sf).where(valid_coordinates("lat", "lng")), B)


def _grid_sql():
    parts = []
    for z in (4, 8, 12):
        cx, cy = geo.web_mercator_cell_sql("lat", "lng", z)
        parts.append(f"SELECT {z} AS zoom, {cx} AS cx, {cy} AS cy, lat, lng FROM latest WHERE {VALID_COORD_SQL}")
    u = " UNION ALL ".join(parts)
    return f"""
, u AS ({u})
SELECT zoom, cx, cy, COUNT(*) AS points, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM u GROUP BY zoom, cx, cy
UNION ALL
SELECT 16 AS zoom, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS BIGINT), round(lat, 6), round(lng, 6) FROM latest WHERE {VALID_COORD_SQL}"""


@register("geo_grid_cells", ol(_grid_sql()))
def q_geo_grid_cells(spark, sf):
    from ..operators.clean import valid_coordinates
    from ..operators.geo_grid import geo_grid_cells
    return geo_grid_cells(_latest(spark, sf).where(valid_coordinates("lat", "lng")), (4, 8, 12, 16), B)


@register("hierarchy_index", oracle(f"""
SELECT {_norm_sql('estado')} AS group_norm, {_norm_sql('zona')} AS zone_norm, {_norm_sql('municipio')} AS municipality_norm,
       {_norm_sql('localidad')} AS locality_norm, {_norm_sql('clave')} AS facility_norm,
       arg_min(estado, period_key) AS "group", arg_min(zona, period_key) AS zone, arg_min(municipio, period_key) AS municipality,
       arg_min(localidad, period_key) AS locality, arg_min(clave, period_key) AS facility, COUNT(*) AS rows,
       CAST(SUM(COUNT(*)) OVER (PARTITION BY {_norm_sql('estado')}) AS BIGINT) AS group_rows
FROM panel
WHERE COALESCE(trim(estado) <> '', false) AND COALESCE(trim(zona) <> '', false) AND COALESCE(trim(municipio) <> '', false)
  AND COALESCE(trim(localidad) <> '', false) AND COALESCE(trim(clave) <> '', false)
GROUP BY 1, 2, 3, 4, 5"""))
def q_hierarchy_index(spark, sf):
    from ..operators.hierarchy import hierarchy_index
    return hierarchy_index(panel(spark, sf), B, "period_key")


_PREFIX_WHERE = """WHERE COALESCE(trim(estado) <> '', false) AND COALESCE(trim(zona) <> '', false) AND COALESCE(trim(municipio) <> '', false)
  AND COALESCE(trim(localidad) <> '', false) AND COALESCE(trim(clave) <> '', false)"""


def _prefix_sql() -> str:
    """One SELECT a level: its path, its first spelling and its rows."""
    cols = ["estado", "zona", "municipio", "localidad", "clave"]
    names = ["group_norm", "zone_norm", "municipality_norm", "locality_norm", "facility_norm"]
    parts = []
    for i, c in enumerate(cols):
        path = ", ".join(f"{_norm_sql(x) if k <= i else 'CAST(NULL AS VARCHAR)'} AS {n}" for k, (x, n) in enumerate(zip(cols, names)))
        parts.append(f"SELECT CAST({i + 1} AS INTEGER) AS level, {path}, first({c} ORDER BY period_key, {c}) AS name, COUNT(*) AS rows "
                     f"FROM panel {_PREFIX_WHERE} GROUP BY {', '.join(_norm_sql(x) for x in cols[:i + 1])}")
    return "\nUNION ALL\n".join(parts)


@register("hierarchy_prefix_table", oracle(f"\n{_prefix_sql()}"))
def q_hierarchy_prefix_table(spark, sf):
    from ..operators.hierarchy import prefix_table
    return prefix_table(panel(spark, sf), B, "period_key")


@register("prefix_children", oracle(f"""
SELECT first(trim(municipio) ORDER BY period_key, trim(municipio)) AS name, COUNT(*) AS rows
FROM panel {_PREFIX_WHERE} AND {_norm_sql('estado')} = 'NATION_1' AND {_norm_sql('zona')} = 'AMERICA' GROUP BY {_norm_sql('municipio')}"""))
def q_prefix_children(spark, sf):
    """Children of one place, from the prepared prefix table: only the files of their level are read."""
    from ..operators.hierarchy import children_of, write_prefix_table
    return children_of(write_prefix_table(panel(spark, sf), _scratch(spark, "prefix"), B, "period_key"), "nátion_1", "america")


@register("available_periods", oracle("""
, g AS (SELECT CAST(anio AS INTEGER) AS year, list_sort(list_distinct(list(CAST(mes AS INTEGER)))) AS months
        FROM panel WHERE mes IS NOT NULL AND mes <> 99 AND anio IS NOT NULL GROUP BY 1)
SELECT year, CAST(len(months) AS INTEGER) AS n_months,
       array_to_string(list_transform(months, lambda x: lpad(CAST(x AS VARCHAR), 2, '0')), ',') AS months
FROM g WHERE len(list_intersect(months, range(1, 13))) = 12 OR year = 2001"""))
def q_available_periods(spark, sf):
    return ag.available_periods(panel(spark, sf), B, current_year=2001)


@register("monthly_trend", oracle(f"""
SELECT anio, mes, COUNT(*) AS rows, {", ".join(f"CAST(round(COALESCE(SUM({m}), 0)) AS BIGINT) AS sum_{m}" for m in LV + ["cn_total"])},
       {pe.month_name_sql('mes')} AS label
FROM panel WHERE lpad(CAST(mes AS VARCHAR), 2, '0') BETWEEN '03' AND '06' GROUP BY anio, mes"""))
def q_monthly_trend(spark, sf):
    return ag.monthly_trend(panel(spark, sf), LV + ["cn_total"], "03", "06", B)


# --------------------------------------------------------------------- windows / positions
VALID_LAT_SQL = "lat <> 0 AND lat BETWEEN 14.5 AND 32.7"


@register("dedup_keep_first", oracle(f"""
SELECT clave, arg_min(period_key, period_key) AS period_key, arg_min(lat, period_key) AS lat, arg_min(cn_total, period_key) AS cn_total
FROM panel WHERE {VALID_LAT_SQL} GROUP BY clave"""))
def q_dedup_keep_first(spark, sf):
    p = panel(spark, sf).select("clave", "period_key", "lat", "cn_total")
    kept, _ = rk.dedup_keep_first(p, "clave", ["period_key"], (F.col("lat") != 0) & F.col("lat").between(14.5, 32.7))
    return kept


@register("index_last_row_per_key", oracle("SELECT upper(trim(clave)) AS key, max(period_key) AS last_position FROM panel GROUP BY 1"))
def q_index_last_row(spark, sf):
    return rk.index_last_row_per_key(panel(spark, sf), "clave", "period_key")


@register("rank_position", oracle(GMT_SQL + """
SELECT estado_id, sum_total, row_number() OVER (ORDER BY sum_total DESC, estado_id) AS rank FROM t"""))
def q_rank_position(spark, sf):
    g = ag.group_measure_totals(panel(spark, sf), B).select("estado_id", "sum_total")
    return rk.rank_small(g, [F.col("sum_total").desc(), F.col("estado_id")])


@register("share_of_total", ol(f"""
, g AS (SELECT estado, CAST(SUM(cn_total) AS BIGINT) AS cn_total FROM latest GROUP BY estado)
SELECT estado, cn_total, {nb.pct_int_sql('cn_total', '(SELECT SUM(cn_total) FROM g)', 2)} AS share FROM g"""))
def q_share_of_total(spark, sf):
    g = _latest(spark, sf).groupBy("estado").agg(F.sum("cn_total").cast("bigint").alias("cn_total"))
    return rk.share_of_total(g, "cn_total")


LEADER_MS = ["cn_inicial", "cn_prim", "cn_sec", "inc_total"]


@register("leader_per_measure", ol(f"""
, u AS ({" UNION ALL ".join(f"SELECT '{m}' AS measure, clave, CAST(COALESCE({m}, 0) AS BIGINT) AS value FROM latest WHERE estado = (SELECT min(estado) FROM latest)" for m in LEADER_MS)}),
  g AS (SELECT measure, CAST(SUM(value) AS BIGINT) AS total, max(value) AS leader_value, arg_min(clave, (-value, clave)) AS leader FROM u GROUP BY measure)
SELECT *, {nb.pct_int_sql('leader_value', 'total', 1)} AS leader_pct FROM g WHERE total > 0"""))
def q_leader_per_measure(spark, sf):
    return rk.leader_per_measure(_latest(spark, sf).where(F.col("estado") == _first_group(spark, sf)), LEADER_MS, B)


@register("facility_history", oracle("""
SELECT clave AS facility, CAST(anio AS INTEGER) AS year, CAST(mes AS INTEGER) AS month, situacion AS status, cn_total
FROM panel WHERE upper(trim(clave)) = 'I-01-012-65'"""))
def q_facility_history(spark, sf):
    from .search import facility_history
    return facility_history(panel(spark, sf), "i-01-012-65", B)


@register("latest_row_lookup", ol("""
SELECT 'latest' AS variant, clave, min(period_key) AS period_key, arg_min(cn_total, period_key) AS cn_total
FROM latest WHERE upper(trim(clave)) = 'I-02-000-55' GROUP BY clave
UNION ALL
SELECT 'detail', clave, min(period_key), arg_min(cn_total, period_key) FROM panel WHERE upper(trim(clave)) = 'I-02-000-55' GROUP BY clave"""))
def q_latest_row_lookup(spark, sf):
    key = "I-02-000-55"
    a = rk.first_per_key(flt.facility_by_key(_latest(spark, sf), key, B).select("clave", "period_key", "cn_total"),
                         "clave", ["period_key"]).withColumn("variant", F.lit("latest"))
    b = rk.first_per_key(flt.facility_by_key(panel(spark, sf), key, B).select("clave", "period_key", "cn_total"),
                         "clave", ["period_key"]).withColumn("variant", F.lit("detail"))
    return a.unionByName(b)


# ----------------------------------------------------------------------------------- top-k
GMT_NAMED_SQL = GMT_SQL + """,
  gn AS (SELECT t.*, COALESCE(n.n_name, 'Estado_' || CAST(t.estado_id AS VARCHAR)) AS group_name FROM t LEFT JOIN nation n ON n.n_nationkey = t.estado_id)"""


def _gmt_named(spark, sf):
    g = ag.group_measure_totals(panel(spark, sf), B)
    return dims.dim_decode(g, "estado_id", _nation_dim(spark, sf), "group_name", "Estado_")


@register("top_groups_by_measure", oracle(GMT_NAMED_SQL + """
SELECT group_name, sum_cn_prim FROM gn ORDER BY sum_cn_prim DESC, group_name LIMIT 5"""))
def q_top_groups_by_measure(spark, sf):
    return rk.top_groups_by_measure(_gmt_named(spark, sf), "sum_cn_prim", 5).select("group_name", "sum_cn_prim")


def _top_per_measure_sql(k: int) -> str:
    u = " UNION ALL ".join(f"SELECT '{c}' AS measure, group_name, sum_{c} AS value FROM gn" for c in LV)
    return GMT_NAMED_SQL + f""",
  u AS ({u}),
  r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, group_name) AS pos FROM u)
SELECT measure, group_name, value, pos FROM r WHERE pos <= {k}"""


def _top_per_measure(spark, sf, k):
    g = _gmt_named(spark, sf).select("group_name", *[F.col(f"sum_{c}").alias(c) for c in LV])
    long = g.unpivot(["group_name"], LV, "measure", "value")
    return rk.top_k_per(long, "measure", [F.col("value").desc(), F.col("group_name")], k)


@register("top1_group_per_measure", oracle(_top_per_measure_sql(1)))
def q_top1_group_per_measure(spark, sf):
    return _top_per_measure(spark, sf, 1)


@register("top5_group_per_measure", oracle(_top_per_measure_sql(5)))
def q_top5_group_per_measure(spark, sf):
    return _top_per_measure(spark, sf, 5)


@register("top5_groups_total", oracle(GMT_NAMED_SQL + "\nSELECT group_name, sum_total FROM gn ORDER BY sum_total DESC, group_name LIMIT 5"))
def q_top5_groups_total(spark, sf):
    return rk.top_groups_by_measure(_gmt_named(spark, sf), "sum_total", 5).select("group_name", "sum_total")


@register("popular_groups", oracle("SELECT estado AS group_name, COUNT(*) AS rows FROM panel GROUP BY estado ORDER BY rows DESC, group_name LIMIT 8"))
def q_popular_groups(spark, sf):
    g = panel(spark, sf).groupBy(F.col("estado").alias("group_name")).agg(F.count(F.lit(1)).alias("rows"))
    return g.orderBy(F.col("rows").desc(), "group_name").limit(8)


@register("max_min_group", ol("""
, g AS (SELECT estado, COUNT(DISTINCT clave) AS n FROM latest GROUP BY estado)
SELECT arg_min(estado, (-n, estado)) AS most_group, max(n) AS most_facilities,
       arg_min(estado, (n, estado)) AS least_group, min(n) AS least_facilities, COUNT(*) AS groups FROM g"""))
def q_max_min_group(spark, sf):
    from .reports import max_min_group
    return max_min_group(_latest(spark, sf), B)


@register("group_list_sorted", oracle(f"""
SELECT estado AS group_name, COUNT(*) AS rows, substring({_norm_sql('estado')}, 1, 10) AS code
FROM panel WHERE estado IS NOT NULL AND trim(estado) <> '' GROUP BY estado ORDER BY estado"""))
def q_group_list_sorted(spark, sf):
    from .reports import group_list_sorted
    return group_list_sorted(panel(spark, sf), B)


@register("sample_rows", oracle("SELECT clave, COALESCE(conectividad, '') AS conectividad, cn_total FROM panel ORDER BY clave, period_key LIMIT 5"))
def q_sample_rows(spark, sf):
    return (panel(spark, sf).orderBy("clave", "period_key").limit(5)
            .select("clave", F.coalesce("conectividad", F.lit("")).alias("conectividad"), "cn_total"))


@register("sort_table_columns", ol("SELECT clave, municipio, cn_total FROM latest ORDER BY cn_total DESC, clave"))
def q_sort_table_columns(spark, sf):
    return _latest(spark, sf).select("clave", "municipio", "cn_total").orderBy(F.col("cn_total").desc(), "clave")


# ------------------------------------------------------------------------------------- sets
@register("distinct_values", oracle("SELECT DISTINCT municipio AS value FROM panel WHERE municipio IS NOT NULL AND trim(municipio) <> ''"))
def q_distinct_values(spark, sf):
    from ..operators.sets import distinct_values
    return distinct_values(panel(spark, sf), "municipio")


@register("cascade_children", oracle(f"""
SELECT DISTINCT estado AS child FROM panel WHERE {_norm_sql('zona')} = 'AMERICA' AND estado IS NOT NULL AND trim(estado) <> ''"""))
def q_cascade_children(spark, sf):
    from ..operators.sets import cascade_children
    return cascade_children(panel(spark, sf), {"zona": "America"}, "estado")


@register("period_values", oracle(f"""
SELECT 'group' AS kind, estado AS value FROM (SELECT DISTINCT estado FROM panel WHERE period_key = 200107)
UNION ALL
SELECT 'measure', m FROM (SELECT unnest(['cn_inicial', 'cn_prim', 'cn_sec', 'inc_total_raw']) AS m,
                                 unnest([COUNT(cn_inicial), COUNT(cn_prim), COUNT(cn_sec), COUNT(inc_total_raw)]) AS n
                          FROM panel WHERE period_key = 200107) WHERE n > 0"""))
def q_period_values(spark, sf):
    from ..operators.sets import period_values
    return period_values(panel(spark, sf), 200107, ["cn_inicial", "cn_prim", "cn_sec", "inc_total_raw"], B)


# ------------------------------------------------------------------------------- comparison
P1, P2 = 200007, 200107


def _cmp_sql(a: int, b: int, clamp: bool = True, pc: str = "period_key", src: str = "panel") -> str:
    val = (lambda c: f"greatest(COALESCE({c}, 0), 0)") if clamp else (lambda c: f"COALESCE({c}, 0)")
    sums = []
    for o, c in CM_SQL:
        sums.append(f"CAST(COALESCE(SUM(CASE WHEN {pc} = {a} THEN {val(c)} END), 0) AS BIGINT) AS {o}_p1")
        sums.append(f"CAST(COALESCE(SUM(CASE WHEN {pc} = {b} THEN {val(c)} END), 0) AS BIGINT) AS {o}_p2")
    derived = ", ".join(f"{o}_p2 - {o}_p1 AS {o}_delta, {nb.pct_int_sql(f'{o}_p2 - {o}_p1', f'{o}_p1')} AS {o}_pct"
                        for o, _ in CM_SQL)
    return f"""
, cg0 AS (SELECT estado_id,
         CAST(SUM(CASE WHEN {pc} = {a} THEN 1 ELSE 0 END) AS BIGINT) AS facilities_p1,
         CAST(SUM(CASE WHEN {pc} = {b} THEN 1 ELSE 0 END) AS BIGINT) AS facilities_p2,
         CAST(SUM(CASE WHEN {pc} = {b} AND situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating_p2,
         {", ".join(sums)}
  FROM {src} WHERE {pc} IN ({a}, {b}) AND estado_id IS NOT NULL GROUP BY estado_id),
  cg AS (SELECT cg0.*, facilities_p2 - facilities_p1 AS facilities_delta, {derived},
                COALESCE(n.n_name, 'Estado_' || CAST(cg0.estado_id AS VARCHAR)) AS group_name
         FROM cg0 LEFT JOIN nation n ON n.n_nationkey = cg0.estado_id),
  ct0 AS (SELECT {", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {c}" for c in ["facilities_p1", "facilities_p2", "operating_p2"] + [f"{o}_{s}" for o, _ in CM_SQL for s in ("p1", "p2")])} FROM cg),
  ct AS (SELECT *, facilities_p2 - facilities_p1 AS facilities_delta, {derived} FROM ct0)
"""


CMP = _cmp_sql(P1, P2)


def _cmp(spark, sf):
    from . import compare as cp
    return cp.compare_by_group(panel(spark, sf), P1, P2, _nation_dim(spark, sf), B, clamp_negative=True)


@register("compare_periods", oracle(CMP + "SELECT * FROM cg"))
def q_compare_periods(spark, sf):
    return _cmp(spark, sf)


@register("period_full_outer", oracle(CMP + "SELECT estado_id, facilities_p1, facilities_p2, cn_total_p1, cn_total_p2 FROM cg"))
def q_period_full_outer(spark, sf):
    return _cmp(spark, sf).select("estado_id", "facilities_p1", "facilities_p2", "cn_total_p1", "cn_total_p2")


@register("compare_totals_row", oracle(CMP + "SELECT * FROM ct"))
def q_compare_totals_row(spark, sf):
    from . import compare as cp
    return cp.compare_totals(_cmp(spark, sf), B)


NR_SQL = f"""
, k AS (SELECT clave, max(CASE WHEN period_key = {P1} THEN 1 ELSE 0 END) AS in1, max(CASE WHEN period_key = {P2} THEN 1 ELSE 0 END) AS in2
        FROM panel WHERE period_key IN ({P1}, {P2}) AND clave IS NOT NULL GROUP BY clave),
  s AS (SELECT CAST(COALESCE(SUM(in1), 0) AS BIGINT) AS keys_p1, CAST(COALESCE(SUM(in2), 0) AS BIGINT) AS keys_p2,
               CAST(SUM(CASE WHEN in2 = 1 AND in1 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_new,
               CAST(SUM(CASE WHEN in1 = 1 AND in2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_removed FROM k),
  nr AS (SELECT keys_p1, keys_p2,
                CASE WHEN keys_p1 > 0 AND keys_p2 > 0 THEN n_new ELSE greatest(keys_p2 - keys_p1, 0) END AS new_facilities,
                CASE WHEN keys_p1 > 0 AND keys_p2 > 0 THEN n_removed ELSE greatest(keys_p1 - keys_p2, 0) END AS removed_facilities FROM s)
"""


@register("new_and_removed_facilities", oracle(NR_SQL + "SELECT * FROM nr"))
def q_new_removed(spark, sf):
    from . import compare as cp
    return cp.new_and_removed(panel(spark, sf), P1, P2, B)


@register("compare_summary_legacy", oracle(CMP + NR_SQL + """
SELECT facilities_p1, facilities_p2, cn_total_p1, cn_total_p2, cn_total_delta, cn_total_pct,
       (SELECT new_facilities FROM nr) AS new_facilities, (SELECT removed_facilities FROM nr) AS removed_facilities,
       'CN Total ' || CASE WHEN cn_total_delta >= 0 THEN '+' ELSE '' END || format('{:,}', cn_total_delta) AS headline
FROM ct"""))
def q_compare_summary(spark, sf):
    from . import compare as cp
    return cp.compare_summary(_cmp(spark, sf), cp.new_and_removed(panel(spark, sf), P1, P2, B), B)


def _share_sql(prefix):
    tot = f"(cn_inicial_{prefix} + cn_prim_{prefix} + cn_sec_{prefix})"
    den = f"(CASE WHEN {tot} = 0 THEN 1 ELSE {tot} END)"
    return [(f"share_{c}_{prefix}", nb.pct_int_sql(f"{c}_{prefix}", den, 2)) for c in LV]


@register("compare_advanced", oracle(CMP + f"""
, best AS (SELECT max(abs(cn_total_delta)) AS m FROM cg),
  sh AS (SELECT cn_total_pct AS growth_rate, {nb.pct_int_sql('cn_total_p2', 'facilities_p2 * 100', 2)} AS efficiency,
                COALESCE((SELECT min(group_name) FROM cg WHERE abs(cn_total_delta) = (SELECT m FROM best) AND (SELECT m FROM best) > 0), 'N/A') AS most_dynamic_group,
                CAST(CASE WHEN (SELECT m FROM best) > 0 THEN (SELECT m FROM best) ELSE 0 END AS BIGINT) AS most_dynamic_change,
                {", ".join(f"{e} AS {n}" for n, e in _share_sql('p1') + _share_sql('p2'))}
         FROM ct)
SELECT *, {", ".join(f"(CAST(round(share_{c}_p2 * 100) AS BIGINT) - CAST(round(share_{c}_p1 * 100) AS BIGINT)) / 100.0 AS share_{c}_delta" for c in LV)}
FROM sh"""))
def q_compare_advanced(spark, sf):
    from . import compare as cp
    return cp.compare_advanced(_cmp(spark, sf), B)


def _score_sql():
    p = "CAST(round(cn_total_pct * 100) AS BIGINT)"
    n = "greatest(facilities_p2, 1)"
    eff = f"(CASE WHEN facilities_p2 > 0 THEN least(cn_total_p2, {n} * 10) ELSE 0 END)"
    num = f"(least({p}, 10000) * 2 * {n} + least(cn_total_delta, 1000) * 15 * {n} + {eff} * 1500)"
    return f"{nb.pct_int_sql(num, f'500 * {n} * 100', 0)} / 10.0"


@register("compare_ranking", oracle(CMP + f"""
, r AS (SELECT group_name, cn_total_delta, cn_total_pct, facilities_p2,
               {nb.pct_int_sql('cn_total_p2', 'facilities_p2 * 100', 2)} AS efficiency, {_score_sql()} AS score FROM cg)
SELECT *, CASE WHEN score >= 8 THEN 'excellent' WHEN score >= 6 THEN 'good' WHEN score >= 4 THEN 'fair' ELSE 'low' END AS score_class,
       row_number() OVER (ORDER BY cn_total_pct DESC, group_name) AS rank FROM r"""))
def q_compare_ranking(spark, sf):
    from . import compare as cp
    return cp.compare_ranking(_cmp(spark, sf))


@register("score_class", oracle(CMP + f"""
SELECT group_name, CASE WHEN s >= 8 THEN 'excellent' WHEN s >= 6 THEN 'good' WHEN s >= 4 THEN 'fair' ELSE 'low' END AS score_class
FROM (SELECT group_name, {_score_sql()} AS s FROM cg)"""))
def q_score_class(spark, sf):
    from . import compare as cp
    return cp.compare_ranking(_cmp(spark, sf)).select("group_name", "score_class")


@register("top3_growth_per_level", oracle(CMP + f"""
, u AS ({" UNION ALL ".join(f"SELECT group_name, '{c}' AS level, {c}_pct AS pct, {c}_delta AS delta FROM cg" for c in LV)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY pct DESC, group_name) AS pos FROM u),
  nat AS ({" UNION ALL ".join(f"SELECT '{c}' AS level, {c}_pct AS national_pct FROM ct" for c in LV)})
SELECT r.level, r.group_name, r.pct, r.delta, r.pos, nat.national_pct,
       CASE WHEN nat.national_pct > 0 THEN 'growth' WHEN nat.national_pct < 0 THEN 'decline' ELSE 'stable' END AS national_label
FROM r JOIN nat USING (level) WHERE pos <= 3"""))
def q_top3_growth(spark, sf):
    from . import compare as cp
    g = _cmp(spark, sf)
    return cp.compare_trends(g, cp.compare_totals(g, B))


@register("compare_executive", oracle(CMP + f"""
, c AS (SELECT CAST(SUM(CASE WHEN cn_total_pct > 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_growing,
               CAST(SUM(CASE WHEN cn_total_pct < -1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_shrinking,
               CAST(SUM(CASE WHEN cn_total_pct BETWEEN -1 AND 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_stable,
               COUNT(*) AS groups FROM cg),
  x AS (SELECT c.*, (SELECT cn_total_pct FROM ct) AS growth_rate, {nb.pct_int_sql('groups_growing', 'groups', 2)} AS pct_groups_growing FROM c)
SELECT *, CASE WHEN growth_rate > 5 THEN 'strongly positive' WHEN growth_rate > 0 THEN 'positive'
               WHEN growth_rate < -5 THEN 'strongly negative' WHEN growth_rate < 0 THEN 'negative' ELSE 'stable' END AS trend,
          CASE WHEN growth_rate > 10 AND pct_groups_growing > 70 THEN 'excellent' WHEN growth_rate > 5 AND pct_groups_growing > 50 THEN 'good'
               WHEN growth_rate > 0 THEN 'moderate' WHEN growth_rate = 0 THEN 'stable' ELSE 'negative' END AS recommendation
FROM x"""))
def q_compare_executive(spark, sf):
    from . import compare as cp
    g = _cmp(spark, sf)
    return cp.compare_executive(g, cp.compare_totals(g, B))


@register("compare_group_card", oracle(CMP + f"""
SELECT group_name, facilities_p1, facilities_p2, facilities_delta,
       {nb.pct_int_sql('facilities_p2 - facilities_p1', 'facilities_p1')} AS facilities_pct,
       {", ".join(f"{c}_{s}" for c in ["cn_total", "cn_inicial", "cn_prim", "cn_sec"] for s in ("p1", "p2", "delta", "pct"))}
FROM cg WHERE {_norm_sql('group_name')} = 'NATION_3'"""))
def q_compare_group_card(spark, sf):
    from . import compare as cp
    return cp.compare_group_card(_cmp(spark, sf), "nation_3")


@register("compare_years", oracle(_cmp_sql(1999, 2000, clamp=False, pc="anio") + "SELECT * FROM cg"))
def q_compare_years(spark, sf):
    from . import compare as cp
    return cp.compare_years(panel(spark, sf), 1999, 2000, _nation_dim(spark, sf), B, current_year=2001)


@register("top_abs_change", oracle(CMP + "SELECT group_name, cn_total_delta FROM cg ORDER BY abs(cn_total_delta) DESC, group_name LIMIT 5"))
def q_top_abs_change(spark, sf):
    return _cmp(spark, sf).orderBy(F.abs("cn_total_delta").desc(), "group_name").limit(5).select("group_name", "cn_total_delta")


@register("sort_group_comparison", oracle(CMP + """
SELECT group_name, cn_total_pct, row_number() OVER (ORDER BY lower(strip_accents(group_name)), group_name) AS by_name,
       row_number() OVER (ORDER BY facilities_p2 DESC, group_name) AS by_facilities,
       row_number() OVER (ORDER BY cn_total_p2 DESC, group_name) AS by_cn,
       row_number() OVER (ORDER BY cn_total_pct DESC, group_name) AS by_pct,
       row_number() OVER (ORDER BY cn_inicial_pct DESC, group_name) AS by_inicial,
       row_number() OVER (ORDER BY cn_prim_pct DESC, group_name) AS by_primaria,
       row_number() OVER (ORDER BY cn_sec_pct DESC, group_name) AS by_secundaria,
       row_number() OVER (ORDER BY facilities_delta DESC, group_name) AS by_delta,
       row_number() OVER (ORDER BY cn_total_p1 DESC, group_name) AS by_cnp1,
       row_number() OVER (ORDER BY abs(cn_total_p2) DESC, group_name) AS by_cnabs FROM cg"""))
def q_sort_group_comparison(spark, sf):
    from .compare import sort_group_comparison
    return sort_group_comparison(_cmp(spark, sf))


# ------------------------------------------------------------------------------ search
def _scored_sql(q: str, kind: str = "todas", limit: int = 20) -> str:
    k = _norm_sql("clave")
    mt = (f"CASE WHEN {k} = '{q}' THEN 'exacta' WHEN contains({k}, '{q}') THEN 'clave_parcial' "
          f"WHEN contains({_norm_sql('estado')}, '{q}') THEN 'estado' WHEN contains({_norm_sql('municipio')}, '{q}') THEN 'municipio' "
          f"WHEN contains({_norm_sql('localidad')}, '{q}') THEN 'localidad' WHEN contains({_norm_sql('nombre')}, '{q}') THEN 'nombre' END")
    sc = ("CASE match_type WHEN 'exacta' THEN 100 WHEN 'clave_parcial' THEN 90 WHEN 'estado' THEN 80 "
          "WHEN 'municipio' THEN 70 WHEN 'localidad' THEN 60 WHEN 'nombre' THEN 50 ELSE 0 END")
    kf = "" if kind == "todas" else f"AND match_type = '{kind}'"
    return f"""
, s AS (SELECT clave AS facility, nombre AS name, estado AS group_name, municipio AS municipality, localidad AS locality,
               {mt} AS match_type FROM latest)
SELECT *, {sc} AS score FROM s WHERE match_type IS NOT NULL {kf} ORDER BY score DESC, facility, name LIMIT {limit}"""


@register("search_scored", ol(_scored_sql("NATION_1")))
def q_search_scored(spark, sf):
    from .search import search_scored
    return search_scored(_latest(spark, sf), "nation_1", B)


@register("match_score", ol(_scored_sql("L3", "localidad", 50)))
def q_match_score(spark, sf):
    from .search import search_scored
    return search_scored(_latest(spark, sf), "l3", B, kind="localidad", limit=50)


GLOBAL_SQL = """
SELECT clave AS facility, min(estado) AS group_name, min(municipio) AS municipality, '' AS address FROM latest
WHERE contains(lower(COALESCE(clave,'')), 'quinas') OR contains(lower(COALESCE(estado,'')), 'quinas')
   OR contains(lower(COALESCE(municipio,'')), 'quinas') OR contains(lower(COALESCE(localidad,'')), 'quinas')
GROUP BY clave ORDER BY facility LIMIT 20"""


@register("search_global", ol(GLOBAL_SQL))
def q_search_global(spark, sf):
    from .search import search_global
    return search_global(_latest(spark, sf), "Quinas", B)


@register("search_limit", ol(GLOBAL_SQL.replace("LIMIT 20", "LIMIT 10")))
def q_search_limit(spark, sf):
    from .search import search_global
    return search_global(_latest(spark, sf), "quinas", B, limit=10)


@register("merge_search_results", ol(f"""
, g AS ({GLOBAL_SQL}),
  s AS (SELECT facility FROM ({_scored_sql("L3", "todas", 40).replace(", s AS", "WITH s AS", 1)})),
  u AS (SELECT facility, 0 AS src FROM g UNION ALL SELECT facility, 1 FROM s WHERE facility NOT IN (SELECT facility FROM g))
SELECT facility, src FROM u ORDER BY src, facility LIMIT 15"""))
def q_merge_search_results(spark, sf):
    from .search import merge_search_results, search_global, search_scored
    l = _latest(spark, sf)
    return merge_search_results(search_global(l, "quinas", B), search_scored(l, "L3", B, limit=40), "facility", 15)


@register("report_facility", ol("""
SELECT clave AS facility, nombre AS name, estado AS group_name, zona AS zone, municipio AS municipality, localidad AS locality,
       period_key AS period, situacion AS status, '' AS address,
       CASE WHEN lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0
            THEN 'https://www.google.com/maps/search/?api=1&query=' || CAST(lat AS VARCHAR) || ',' || CAST(lng AS VARCHAR) END AS map_url,
       CAST(cn_inicial AS VARCHAR) || ',' || CAST(cn_prim AS VARCHAR) || ',' || CAST(cn_sec AS VARCHAR) || ',' || CAST(cn_total AS VARCHAR) AS certificates,
       (SELECT COUNT(*) FROM panel p WHERE p.clave = latest.clave) AS history_periods,
       (SELECT string_agg(CAST(period_key AS VARCHAR) || ':' || CAST(situacion AS VARCHAR) || ':' || CAST(cn_total AS VARCHAR), ',' ORDER BY period_key DESC)
        FROM panel p WHERE p.clave = latest.clave) AS history,
       (SELECT COUNT(*) FROM panel p WHERE p.clave = latest.clave) AS images,
       (SELECT string_agg(clave || '-' || CAST(period_key AS VARCHAR), ',' ORDER BY period_key) FROM panel p WHERE p.clave = latest.clave) AS image_files
FROM latest WHERE clave = (SELECT min(clave) FROM latest)"""))
def q_report_facility(spark, sf):
    """The first facility of the latest period; of its profile, the certificates category as text."""
    from .search import report_facility
    key = _latest(spark, sf).agg(F.min("clave")).first()[0] or ""
    out = report_facility(panel(spark, sf), _latest(spark, sf), key.lower(), B, images=_index(spark, sf))
    cert = F.concat_ws(",", *[F.col(f"profile.certificates.{c}") for c in ("cn_inicial", "cn_prim", "cn_sec", "cn_total")])
    hist = F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["period_key"], x["situacion"], x["cn_total"])), ",")
    return out.select("facility", "name", "group_name", "zone", "municipality", "locality", "period", "status", "address", "map_url",
                      cert.alias("certificates"), F.size("history").cast("long").alias("history_periods"), hist.alias("history"),
                      F.size("images").cast("long").alias("images"), F.array_join(F.transform("images", lambda x: x["file_id"]), ",").alias("image_files"))


@register("report_group_facilities", ol("""
SELECT clave AS facility, concat_ws(', ', NULLIF(trim(municipio), ''), NULLIF(trim(localidad), '')) AS address,
       municipio AS municipality, localidad AS locality FROM latest WHERE estado = (SELECT min(estado) FROM latest)"""))
def q_report_group_facilities(spark, sf):
    from .reports import report_group_facilities
    return report_group_facilities(_latest(spark, sf), _first_group(spark, sf), B.with_(neighbourhood="municipio", street="localidad"))


METRIC_COLS = ["inc_total_raw", "aten_total", "cn_inicial", "cn_prim", "cn_sec", "cn_total", "inc_total", "lat", "lng", "situacion"]


@register("metric_row_projection", ol(f"""
SELECT COALESCE(trim(clave), 'N/D') AS facility, COALESCE(trim(nombre), 'N/D') AS name, COALESCE(trim(municipio), 'N/D') AS municipality,
       {", ".join(f"COALESCE(CAST(trunc(TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS {m}" for m in METRIC_COLS)}
FROM latest WHERE estado = (SELECT min(estado) FROM latest)"""))
def q_metric_row_projection(spark, sf):
    from .reports import metric_row_projection
    return metric_row_projection(_latest(spark, sf).where(F.col("estado") == _first_group(spark, sf)), METRIC_COLS, B)


# ----------------------------------------------------------------------- coordinate export
RAW_COORDS_SQL = """
, raw AS (SELECT CASE WHEN mes = 5 THEN '' WHEN mes = 6 THEN 'nan' ELSE clave END AS clave, period_key, estado, municipio,
                 CASE WHEN mes = 1 THEN replace(CAST(lat AS VARCHAR), '.', ',') WHEN mes = 2 THEN 'abc'
                      WHEN mes = 3 THEN 'NaN' WHEN mes = 4 THEN 'inf' ELSE CAST(lat AS VARCHAR) END AS lat_raw,
                 CAST(lng AS VARCHAR) AS lng_raw FROM panel),
  cls AS (SELECT *, CASE WHEN lower(COALESCE(trim(clave), '')) IN ('', 'nan', 'none', 'nat') THEN '' ELSE trim(clave) END AS key_clean,
                 TRY_CAST(replace(trim(lat_raw), ',', '.') AS DOUBLE) AS la, TRY_CAST(replace(trim(lng_raw), ',', '.') AS DOUBLE) AS lo FROM raw),
  rs AS (SELECT *, CASE WHEN key_clean = '' THEN 'no_key' WHEN la IS NULL OR lo IS NULL THEN 'not_numeric'
                        WHEN isnan(la) OR isnan(lo) THEN 'nan' WHEN isinf(la) OR isinf(lo) THEN 'infinite'
                        WHEN la = 0 OR lo = 0 THEN 'zero' WHEN NOT (la BETWEEN 14.5 AND 32.7) THEN 'lat_out_of_range'
                        WHEN NOT (lo BETWEEN -118.5 AND -86.7) THEN 'lng_out_of_range' END AS reason FROM cls)
"""


def _raw_coords(spark, sf):
    p = panel(spark, sf)
    lat_s = F.col("lat").cast("string")
    return p.select(
        F.when(F.col("mes") == 5, F.lit("")).when(F.col("mes") == 6, F.lit("nan")).otherwise(F.col("clave")).alias("clave"),
        "period_key", "estado", "municipio",
        F.when(F.col("mes") == 1, F.replace(lat_s, F.lit("."), F.lit(","))).when(F.col("mes") == 2, F.lit("abc"))
         .when(F.col("mes") == 3, F.lit("NaN")).when(F.col("mes") == 4, F.lit("inf")).otherwise(lat_s).alias("lat_raw"),
        F.col("lng").cast("string").alias("lng_raw"))


def _export(spark, sf):
    from .jobs import job_export_coordinates
    raw = _raw_coords(spark, sf).withColumnRenamed("lat_raw", "Latitud").withColumnRenamed("lng_raw", "Longitud")
    return job_export_coordinates(raw, "period_key")


@register("coordinate_validity", oracle(RAW_COORDS_SQL + "SELECT key_clean, period_key, reason FROM rs"))
def q_coordinate_validity(spark, sf):
    from ..operators.clean import classify_coordinates
    return classify_coordinates(_raw_coords(spark, sf), "clave", "lat_raw", "lng_raw").select("key_clean", "period_key", "reason")


@register("clean_counters", oracle(RAW_COORDS_SQL + """
SELECT COUNT(*) AS rows, CAST(SUM(CASE WHEN reason = 'no_key' THEN 1 ELSE 0 END) AS BIGINT) AS no_key,
       CAST(SUM(CASE WHEN reason IS NOT NULL AND reason <> 'no_key' THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
       CAST(SUM(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS valid,
       COUNT(DISTINCT CASE WHEN reason IS NULL THEN key_clean END) AS kept,
       CAST(SUM(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) - COUNT(DISTINCT CASE WHEN reason IS NULL THEN key_clean END) AS duplicates
FROM rs"""))
def q_clean_counters(spark, sf):
    return _export(spark, sf)[2]


EXPORT_SQL = RAW_COORDS_SQL + """
, kept AS (SELECT key_clean AS facility, min(period_key) AS row_order, round(arg_min(la, period_key), 7) AS lat,
                  round(arg_min(lo, period_key), 7) AS lng, COALESCE(trim(arg_min(estado, period_key)), '') AS estado,
                  COALESCE(trim(arg_min(municipio, period_key)), '') AS municipio
           FROM rs WHERE reason IS NULL GROUP BY key_clean)
"""


@register("job_export_coordinates", oracle(EXPORT_SQL + "SELECT * FROM kept"))
def q_job_export_coordinates(spark, sf):
    return _export(spark, sf)[0]


@register("job_export_coordinates_latest", oracle("""
SELECT clave AS facility, period_key AS row_order, round(lat, 7) AS lat, round(lng, 7) AS lng, COALESCE(trim(estado), '') AS estado,
       COALESCE(trim(municipio), '') AS municipio, COALESCE(trim(localidad), '') AS "Localidad", CAST(situacion AS VARCHAR) AS "Estatus"
FROM panel WHERE period_key = (SELECT max(period_key) FROM panel) AND lat BETWEEN 14.5 AND 32.7 AND lng BETWEEN -118.5 AND -86.7"""))
def q_job_export_coordinates_latest(spark, sf):
    """The newest period only, with locality and status."""
    from .jobs import job_export_coordinates
    raw = panel(spark, sf).select("clave", "period_key", F.col("period_key").cast("string").alias("YYYYMM"), F.col("lat").cast("string").alias("Latitud"),
                                  F.col("lng").cast("string").alias("Longitud"), "estado", "municipio", F.col("localidad").alias("Localidad"),
                                  F.col("situacion").cast("string").alias("Estatus"))
    return job_export_coordinates(raw, "period_key")[0]


@register("dedup_coordinates_per_group", oracle(EXPORT_SQL + "SELECT estado, COUNT(*) AS points FROM kept GROUP BY estado"))
def q_dedup_coordinates_per_group(spark, sf):
    return _export(spark, sf)[0].groupBy("estado").agg(F.count(F.lit(1)).alias("points"))


@register("sink_rejects", oracle(RAW_COORDS_SQL + "SELECT reason, COUNT(*) AS rows FROM rs WHERE reason IS NOT NULL AND reason <> 'no_key' GROUP BY reason"))
def q_sink_rejects(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import sink_table
    import uuid
    path = scratch_path(spark, f"rejects-{uuid.uuid4().hex[:12]}")
    sink_table(_export(spark, sf)[1], path, "parquet")
    return spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@register("sink_records_json", oracle(EXPORT_SQL + "SELECT COUNT(*) AS records, round(SUM(lat), 4) AS lat_sum, COUNT(DISTINCT facility) AS facilities FROM kept"))
def q_sink_records_json(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import sink_table
    import uuid
    path = scratch_path(spark, f"coords-{uuid.uuid4().hex[:12]}")
    sink_table(_export(spark, sf)[0], path, "json")
    back = spark.read.schema("facility string, row_order int, lat double, lng double, estado string, municipio string").json(path)
    return back.agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("lat"), 4).alias("lat_sum"),
                    F.count_distinct("facility").alias("facilities"))


@register("scan_coordinates_json", oracle(EXPORT_SQL + """
SELECT facility AS clave, round(lat, 6) AS lat, round(lng, 6) AS lng, estado, municipio FROM kept"""))
def q_scan_coordinates_json(spark, sf):
    from ..session import scratch_path
    from ..sources.json_sources import scan_coordinates_json
    from ..sources.sinks import sink_table
    import uuid
    path = scratch_path(spark, f"coords-{uuid.uuid4().hex[:12]}")
    recs = _export(spark, sf)[0].select(F.col("facility").alias("clave"), F.col("lat").cast("string").alias("lat"),
                                        F.col("lng").cast("string").alias("lng"), "estado", "municipio")
    sink_table(recs, path, "json")
    return scan_coordinates_json(spark, path, ["estado", "municipio"])


@register("report_coordinates", ol(f"""
SELECT estado, COUNT(*) AS points FROM latest WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY estado"""))
def q_report_coordinates(spark, sf):
    from .reports import report_coordinates
    table_, per_group = report_coordinates(_latest(spark, sf), B)
    return per_group


_COORDINATE_ROWS = """SELECT COALESCE(clave, '') AS clave, round(lat, 6) AS lat, round(lng, 6) AS lng, COALESCE(nombre, '') AS nombre,
       COALESCE(estado, '') AS estado, COALESCE(municipio, '') AS municipio, COALESCE(localidad, '') AS localidad,
       COALESCE(CAST(situacion AS VARCHAR), '') AS situacion"""


def _coordinate_document(spark, sf, refused: bool) -> str:
    """The latest month's facilities with coordinates as one JSON list; a refused one has an object first that
    has no lat."""
    from .reports import coordinate_table
    rows = coordinate_table(_latest(spark, sf), B).withColumn("lat", F.col("lat").cast("string"))
    one = rows.agg(F.concat_ws(",", F.lit('{"lng": 1}') if refused else F.lit(None).cast("string"), F.collect_list(F.to_json(F.struct("*")))).alias("t"))
    path = _scratch(spark, "coords-document")
    one.select(F.concat(F.lit("["), "t", F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return path


@register("coordinate_table_document", ol(f"\n{_COORDINATE_ROWS} FROM latest WHERE lat IS NOT NULL AND lng IS NOT NULL"))
def q_coordinate_table_document(spark, sf):
    """From a good document: the panel given beside it has no rows."""
    from .reports import coordinate_table
    return coordinate_table(_latest(spark, sf).where(F.lit(False)), B, _coordinate_document(spark, sf, refused=False))


@register("coordinate_table_fallback", ol(f"\n{_COORDINATE_ROWS} FROM latest WHERE lat IS NOT NULL AND lng IS NOT NULL"))
def q_coordinate_table_fallback(spark, sf):
    """The document is refused, so the panel gives the rows."""
    from .reports import coordinate_table
    return coordinate_table(_latest(spark, sf), B, _coordinate_document(spark, sf, refused=True))


# -------------------------------------------------------------------------- cleaning job
RAW_HEADERS = {"clave": "Clave Plaza", "nombre": "Nombre_PC", "estado": "  ENTIDAD federativa ", "estado_id": "Clave_Edo",
               "zona": "Coord. Zona", "municipio": "MUNICIPIO ", "localidad": "Localidad", "anio": "Año", "mes": "Cve-mes",
               "situacion": "Situación", "conectividad": "Conect_Instalada", "lat": "Latitud", "lng": "Longitud",
               "inc_total_raw": "Inc_Total", "cn_inicial": "CN_Inicial_Acum", "cn_prim": "CN_Prim_Acum",
               "cn_sec": "CN_Sec_Acum", "cn_total": "CN_Tot_Acum", "aten_total": "Aten_Total", "period_key": "Foo"}


def _raw_csv(spark, sf) -> str:
    """The panel written as a raw delimited file (text everywhere, status as its label)."""
    import uuid
    from ..session import scratch_path
    p = dims.dim_decode(panel(spark, sf), "situacion", dims.statuses_dim(spark), "status_text", "Situación_")
    cols = [(F.col("status_text") if k == "situacion" else F.col(k)).cast("string").alias(v) for k, v in RAW_HEADERS.items()]
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}.csv")
    p.select(*cols).write.option("header", True).csv(path)
    return path


def _clean_sql() -> str:
    from ..operators.clean import INT_FIELDS, STRING_FIELDS
    present = {
        "clave": "trim(clave)", "nombre": "COALESCE(trim(nombre), '')", "estado": "trim(estado)",
        "zona": "trim(zona)", "municipio": "trim(municipio)", "localidad": "trim(localidad)",
        "conectividad": "COALESCE(trim(conectividad), '')", "estado_id": "CAST(estado_id AS BIGINT)",
        "anio": "CAST(anio AS BIGINT)", "inc_total": f"COALESCE(TRY_CAST(round_even({SAFE_NUM_SQL}, 0) AS BIGINT), 0)",
        "aten_total": "CAST(aten_total AS BIGINT)", "cn_inicial": "cn_inicial", "cn_prim": "cn_prim",
        "cn_sec": "cn_sec", "cn_total": "cn_total"}
    cols = [f"{present[f]} AS {f}" if f in present else f"CAST(NULL AS VARCHAR) AS {f}" for f in STRING_FIELDS]
    cols += [f"{present[f]} AS {f}" if f in present else f"CAST(NULL AS BIGINT) AS {f}" for f in INT_FIELDS]
    cols += ["COALESCE(lat, 0.0) AS lat", "COALESCE(lng, 0.0) AS lng", "CAST(mes AS INTEGER) AS mes",
             "CASE WHEN situacion = 1 THEN 1 ELSE 0 END AS situacion", "anio * 100 + mes AS period_key"]
    return "SELECT " + ",\n       ".join(cols) + "\nFROM panel"


CLEAN_SQL = _clean_sql()


@register("job_clean_panel", oracle(CLEAN_SQL))
def q_job_clean_panel(spark, sf):
    from .jobs import job_clean_panel
    df, _ = job_clean_panel(spark, _raw_csv(spark, sf))
    return df


@register("standardise_types", oracle(f"SELECT clave, inc_total, lat, situacion, mes FROM ({CLEAN_SQL})"))
def q_standardise_types(spark, sf):
    from .jobs import job_clean_panel
    df, _ = job_clean_panel(spark, _raw_csv(spark, sf))
    return df.select("clave", "inc_total", "lat", "situacion", "mes")


#: How each header of the raw file must be recognised, and the panel column that it holds.
RAW_MATCHES = [("clave", "Clave Plaza", "exact"), ("nombre", "Nombre_PC", "exact"), ("estado", "ENTIDAD federativa", "normalised"),
               ("estado_id", "Clave_Edo", "exact"), ("zona", "Coord. Zona", "exact"), ("municipio", "MUNICIPIO", "exact"),
               ("localidad", "Localidad", "exact"), ("anio", "Año", "exact"), ("mes", "Cve-mes", "exact"),
               ("situacion", "Situación", "exact"), ("conectividad", "Conect_Instalada", "exact"), ("lat", "Latitud", "exact"),
               ("lng", "Longitud", "exact"), ("inc_total", "Inc_Total", "exact"), ("cn_inicial", "CN_Inicial_Acum", "exact"),
               ("cn_prim", "CN_Prim_Acum", "exact"), ("cn_sec", "CN_Sec_Acum", "exact"), ("cn_total", "CN_Tot_Acum", "exact"),
               ("aten_total", "Aten_Total", "exact")]


@register("resolve_aliases", oracle(" UNION ALL ".join(
    f"SELECT '{f}' AS field, '{src}' AS source, '{how}' AS method, COUNT({'inc_total_raw' if f == 'inc_total' else f}) AS filled FROM panel"
    for f, src, how in RAW_MATCHES)))
def q_resolve_aliases(spark, sf):
    """Fields found in the raw file's header, how, and the rows that hold a value."""
    from ..operators.clean import apply_aliases, resolve_aliases, trim_column_names
    from ..sources.delimited import scan_delimited
    raw = trim_column_names(scan_delimited(spark, _raw_csv(spark, sf)))
    mapping, report = resolve_aliases(raw.columns)
    found = [r for r in report if r[1] is not None]
    one = apply_aliases(raw, mapping).agg(*[F.count(f).alias(f) for f, _, _ in found])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(src).alias("source"), F.lit(how).alias("method"),
                                                   F.col(f).alias("filled")) for f, src, how in found])).alias("r")).select("r.*")


# ----------------------------------------------------------------------------- streaming
@register("incremental_period_load", oracle("""
SELECT period_key, estado_id, COUNT(*) AS rows, CAST(SUM(CASE WHEN situacion = 1 THEN 1 ELSE 0 END) AS BIGINT) AS operating,
       CAST(COALESCE(SUM(cn_inicial), 0) AS BIGINT) AS sum_cn_inicial, CAST(COALESCE(SUM(cn_prim), 0) AS BIGINT) AS sum_cn_prim,
       CAST(COALESCE(SUM(cn_sec), 0) AS BIGINT) AS sum_cn_sec, CAST(COALESCE(SUM(cn_total), 0) AS BIGINT) AS sum_cn_total
FROM panel GROUP BY period_key, estado_id"""))
def q_incremental_period_load(spark, sf):
    """Files whose rows mix periods (any writer's layout, each period in many files) arrive in a
    folder; the stream loads them in several micro-batches and the summary table is read back."""
    import uuid
    from ..session import scratch_path
    from ..streaming.incremental import incremental_period_load
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex[:12]}")
    p = panel(spark, sf)
    src = p.drop("period_key").withColumn("period_key", F.col("anio") * 100 + F.col("mes"))
    src.write.parquet(f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    incremental_period_load(spark, f"{base}/landing", schema, f"{base}/panel", f"{base}/summary",
                            f"{base}/_checkpoint", B, files_per_trigger=1)
    return spark.read.parquet(f"{base}/summary")


# ------------------------------------------------------------------- composite reports
@register("report_status", ol(f"""
SELECT g.status, g.rows, {nb.pct_int_sql('g.rows', '(SELECT COUNT(*) FROM latest)', 2)} AS pct,
       CASE WHEN g.status IS NULL THEN 'Sin información' ELSE COALESCE(s.dim_name, 'Situación_' || CAST(g.status AS VARCHAR)) END AS status_name
FROM (SELECT situacion AS status, COUNT(*) AS rows FROM latest GROUP BY situacion) g
LEFT JOIN {STATUSES_SQL} s ON s.dim_id = g.status ORDER BY rows DESC"""))
def q_report_status(spark, sf):
    return ag.status_distribution(_latest(spark, sf), B, dims.statuses_dim(spark)).orderBy(F.col("rows").desc())


@register("report_nearby", _radius_oracle("""
SELECT r.point_id, r.facility, r.distance_km, r.pos, l.nombre, l.municipio FROM r JOIN latest l ON l.clave = r.facility WHERE pos <= 10"""))
def q_report_nearby(spark, sf):
    from ..operators.nearby import radius_join
    from ..sources.testbind import points
    l = _latest(spark, sf)
    h = radius_join(points(spark, sf), l, 150.0, B, limit_per_point=10).drop("distance_km_exact")
    return h.join(l.select(F.col("clave").alias("facility"), "nombre", "municipio"), "facility")


@register("report_national_summary", oracle(f"""
, ms AS ({_measure_summary_sql(LV).replace(", u AS", "WITH u AS", 1)})
{GMT_SQL}
SELECT 'measure' AS section, measure AS name, total AS value, nulls, pct_null, operating_positive FROM ms
UNION ALL
SELECT *, NULL, NULL, NULL FROM (SELECT 'top_group', CAST(estado_id AS VARCHAR), sum_total FROM t ORDER BY sum_total DESC, estado_id LIMIT 5)"""))
def q_report_national_summary(spark, sf):
    from .reports import is_latest, report_national_summary
    p = panel(spark, sf)
    return report_national_summary(p, is_latest(p, B), B)


@register("report_general_stats", ol(f"""
, g AS (SELECT estado, COUNT(DISTINCT clave) AS n, COUNT(*) AS rows, COUNT(DISTINCT CASE WHEN situacion = 1 THEN clave END) AS op,
               COUNT(DISTINCT CASE WHEN situacion = 0 THEN clave END) AS susp, COUNT(DISTINCT (clave, situacion)) AS pairs,
               CAST(SUM(CASE WHEN {LOOSE_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS conn FROM latest GROUP BY estado),
  h AS (SELECT *, {nb.pct_int_sql('op', 'pairs', 2)} AS op_pct, {nb.pct_int_sql('susp', 'pairs', 2)} AS susp_pct,
               {nb.pct_int_sql('conn', 'rows', 2)} AS conn_pct FROM g)
SELECT 'facilities' AS metric, '' AS name, CAST(COUNT(DISTINCT clave) AS DOUBLE) AS value FROM latest
UNION ALL SELECT 'operating', '', CAST(COUNT(DISTINCT CASE WHEN situacion = 1 THEN clave END) AS DOUBLE) FROM latest
UNION ALL SELECT 'groups', '', CAST(COUNT(*) AS DOUBLE) FROM h
UNION ALL SELECT 'most_facilities', arg_min(estado, (-n, estado)), CAST(max(n) AS DOUBLE) FROM h
UNION ALL SELECT 'least_facilities', arg_min(estado, (n, estado)), CAST(min(n) AS DOUBLE) FROM h
UNION ALL SELECT 'best_connectivity_pct', arg_min(estado, (-conn_pct, estado)), max(conn_pct) FROM h
UNION ALL SELECT 'best_operating_pct', arg_min(estado, (-op_pct, estado)), max(op_pct) FROM h
UNION ALL SELECT 'highest_suspension_pct', arg_min(estado, (-susp_pct, estado)), max(susp_pct) FROM h
""" + "\n".join(f"UNION ALL SELECT '{m}', '', CAST(COALESCE(SUM({c}), 0) AS DOUBLE) FROM latest" for m, c in (
    ("computers_total", "inc_total"), ("computers_operating", "aten_total"), ("servers_total", "cn_total"), ("servers_operating", "cn_sec"),
    ("tables_total", "cn_prim"), ("cert_initial_total", "cn_inicial"), ("cert_primary_total", "cn_prim"), ("cert_secondary_total", "cn_sec"),
    ("cert_total_total", "cn_total")))
    + f"\nUNION ALL SELECT 'computers_operating_pct', '', {nb.pct_int_sql('SUM(aten_total)', 'SUM(inc_total)', 2)} FROM latest"
    + f"\nUNION ALL SELECT 'servers_operating_pct', '', {nb.pct_int_sql('SUM(cn_sec)', 'SUM(cn_total)', 2)} FROM latest"))
def q_report_general_stats(spark, sf):
    """Equipment and furniture columns are bound to measures of the panel."""
    from .reports import report_general_stats
    l = _latest(spark, sf)
    return report_general_stats(l.select("*", F.col("inc_total").alias("eq_total"), F.col("aten_total").alias("eq_operan"),
                                         F.col("cn_total").alias("srv_total"), F.col("cn_sec").alias("srv_operan"), F.col("cn_prim").alias("mesas")), B)


@register("add_normalised_columns", oracle(f"""
SELECT clave, period_key, {_norm_sql('estado')} AS normalized_group, {_norm_sql('zona')} AS normalized_zone,
       {_norm_sql('municipio')} AS normalized_municipality, {_norm_sql('localidad')} AS normalized_locality,
       {_norm_sql('clave')} AS normalized_key, '' AS normalized_neighbourhood FROM panel"""))
def q_add_normalised_columns(spark, sf):
    from ..operators.clean import add_normalised_columns
    cols = {"group": "estado", "zone": "zona", "municipality": "municipio", "locality": "localidad", "key": "clave",
            "neighbourhood": "colonia"}
    return add_normalised_columns(panel(spark, sf).select("clave", "period_key", "estado", "zona", "municipio", "localidad"),
                                  cols).drop("estado", "zona", "municipio", "localidad")


@register("drop_internal_columns", oracle("SELECT clave, period_key, estado FROM panel"))
def q_drop_internal_columns(spark, sf):
    from ..operators.clean import add_normalised_columns, drop_internal_columns
    p = add_normalised_columns(panel(spark, sf).select("clave", "period_key", "estado"), {"group": "estado"})
    return drop_internal_columns(p.withColumn("__row", F.lit(1)))


@register("null_safe_output", oracle("SELECT clave, period_key, CASE WHEN lat = 0 THEN NULL ELSE lat END AS lat FROM panel"))
def q_null_safe_output(spark, sf):
    from ..operators.clean import null_safe_output
    p = panel(spark, sf).select("clave", "period_key", F.when(F.col("lat") == 0, F.lit(float("nan"))).otherwise(F.col("lat")).alias("lat"))
    return null_safe_output(p)


@register("schema_report", oracle("""
SELECT 'inc_total_raw' AS "column", 'recognised' AS status, COUNT(inc_total_raw) AS non_null,
       CAST(SUM(CASE WHEN inc_total_raw IS NOT NULL AND TRY_CAST(inc_total_raw AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_numeric FROM panel
UNION ALL SELECT 'cn_total', 'recognised', COUNT(cn_total), CAST(0 AS BIGINT) FROM panel
UNION ALL SELECT 'extra_column', 'unknown', NULL, NULL
UNION ALL SELECT 'eq_total', 'missing', NULL, NULL"""))
def q_schema_report(spark, sf):
    from ..operators.clean import schema_report
    p = panel(spark, sf).select("clave", "inc_total_raw", "cn_total", F.lit(1).alias("extra_column"))
    return schema_report(p, ["clave", "inc_total_raw", "cn_total", "eq_total"], ["inc_total_raw", "cn_total", "eq_total"])


@register("sink_panel_partitioned", oracle("SELECT period_key, COUNT(*) AS rows FROM panel GROUP BY period_key"))
def q_sink_panel_partitioned(spark, sf):
    import uuid
    from ..session import scratch_path
    from ..sources.panel import sink_panel_partitioned
    path = scratch_path(spark, f"sink-{uuid.uuid4().hex[:12]}")
    sink_panel_partitioned(panel(spark, sf), path, ("period_key",), "clave", tasks=3)
    return spark.read.parquet(path).groupBy("period_key").agg(F.count(F.lit(1)).alias("rows"))


@register("first_load_materialise", oracle("SELECT COUNT(*) AS rows, COUNT(DISTINCT period_key) AS periods FROM panel"))
def q_first_load_materialise(spark, sf):
    import uuid
    from ..session import scratch_path
    from ..sources.panel import first_load_materialise
    path = scratch_path(spark, f"first-{uuid.uuid4().hex[:12]}")
    first_load_materialise(spark, panel(spark, sf), path)
    df = first_load_materialise(spark, panel(spark, sf), path)  # second call: table exists, nothing written
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("period_key").alias("periods"))


@register("scan_delimited", oracle("SELECT COUNT(*) AS rows, COUNT(DISTINCT clave) AS keys FROM panel"))
def q_scan_delimited(spark, sf):
    from ..sources.delimited import scan_delimited
    raw = scan_delimited(spark, _raw_csv(spark, sf))
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("Clave Plaza").alias("keys"))


# ---------------------------------------------------------------------------- image catalogue
def _image_tree(spark, sf) -> str:
    """An image folder tree derived from the whole panel, written once for each state of the tables."""
    from ..sources.prepared import prepared
    from ..sources.testbind import PANEL_VERSION
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in ("orders", "lineitem", "customer", "nation", "region")]
    return prepared(spark, "imgtree", inputs, PANEL_VERSION, "", lambda path: _write_image_tree(spark, sf, path))


def _write_image_tree(spark, sf, path: str) -> None:
    """One folder per facility, one image per period; folder naming varies by group (new ``k`` field,
    decorated old names), written as packed JSON lines of state nodes (a state is split into chunks of <= 500
    folders)."""
    from ..sources.panel import writer_tasks
    p = panel(spark, sf)
    # only keys of the folder pattern can be recognised in a decorated name
    v = F.when(F.length("clave") > 11, F.lit(0)).otherwise(F.col("estado_id") % 4)
    name = (F.when(v == 1, F.concat("estado", F.lit("_"), "clave"))
            .when(v == 2, F.replace("clave", F.lit("I-"), F.lit("l-")))
            .when(v == 3, F.concat("clave", F.lit(" (1)"))))
    f = F.struct(F.concat("clave", F.lit("-"), F.col("period_key").cast("string")).alias("i"),
                 F.concat(F.lit("foto_"), F.col("period_key").cast("string"), F.lit(".jpg")).alias("n"),
                 F.col("cn_total").alias("s"),
                 F.concat(F.col("anio").cast("string"), F.lit("-"), F.lpad(F.col("mes").cast("string"), 2, "0"),
                          F.lit("-01")).alias("m"),
                 F.when(F.col("mes") % 2 == 0, F.concat(F.lit("https://img.example/"), "clave", F.lit("/"),
                                                         F.col("period_key").cast("string"))).alias("mediumUrl"))
    per_state = p.select("estado_id", "estado", "clave").distinct().groupBy("estado_id").agg(F.count(F.lit(1)).alias("n"))
    # dealt once, by state and chunk: folders and state nodes are put together where their files then are, in tasks
    # sized by the rows, whatever the session's number of shuffle partitions
    tasks = max(writer_tasks(p), spark.sparkContext.defaultParallelism)
    chunked = (p.join(bounded_broadcast(per_state), "estado_id")  # one row per group, size-checked
               .withColumn("chunk", F.pmod(F.xxhash64("clave"), F.greatest(F.ceil(F.col("n") / 500), F.lit(1))))
               .repartition(tasks, "estado_id", "estado", "chunk"))
    folders = (chunked.groupBy("estado_id", "estado", "chunk", "clave")
               .agg(F.sort_array(F.collect_list(F.struct("period_key", f.alias("file")))).alias("files"))
               .select("estado_id", "estado", "chunk", "clave",
                       F.struct(F.when(v == 0, F.lower("clave")).alias("k"), name.alias("name"),
                                F.lit("folder").alias("type"),
                                F.transform("files", lambda x: x["file"]).alias("children")).alias("folder")))
    nodes = (folders.groupBy("estado_id", "estado", "chunk")
             .agg(F.sort_array(F.collect_list(F.struct("clave", "folder"))).alias("fs"))
             .select((F.col("estado_id").cast("long") * (1 << 40) + F.col("chunk")).alias("pos"),
                     F.col("estado_id").alias("id"), "estado", F.lit("folder").alias("type"),
                     F.transform("fs", lambda x: x["folder"]).alias("children")))
    nodes.write.mode("overwrite").option("compression", "gzip").json(path)  # every writer's file is one reader's


def _index(spark, sf):
    from ..operators.image_index import image_index
    return image_index(spark, _image_tree(spark, sf))


def _images(spark, sf):
    """The flattened images, from the prepared index."""
    return _index(spark, sf).images()


IMAGES_SQL = """
, img AS (SELECT estado_id AS state_id, estado AS state, lower(clave) AS key,
                 CASE WHEN length(clave) > 11 THEN NULL ELSE CASE estado_id % 4 WHEN 0 THEN NULL WHEN 1 THEN estado || '_' || clave
                      WHEN 2 THEN replace(clave, 'I-', 'l-') ELSE clave || ' (1)' END END AS alias,
                 clave || '-' || CAST(period_key AS VARCHAR) AS file_id, 'foto_' || CAST(period_key AS VARCHAR) || '.jpg' AS file_name,
                 cn_total AS size, CAST(anio AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0') || '-01' AS modified,
                 COALESCE(CASE WHEN mes % 2 = 0 THEN 'https://img.example/' || clave || '/' || CAST(period_key AS VARCHAR) END,
                          'https://drive.google.com/thumbnail?id=' || clave || '-' || CAST(period_key AS VARCHAR) || '&sz=w800') AS url,
                 mes
          FROM panel)
"""


@register("scan_image_tree", oracle(IMAGES_SQL + "SELECT state_id, state, key, alias, file_id, file_name, size, modified, url FROM img"))
def q_scan_image_tree(spark, sf):
    from ..operators.images import read_state_nodes, scan_image_tree
    return scan_image_tree(read_state_nodes(spark, _image_tree(spark, sf))).drop("folder_order")


@register("image_counts", oracle(IMAGES_SQL + """
SELECT state, COUNT(*) AS images, COUNT(DISTINCT key) AS folders FROM img GROUP BY state
UNION ALL SELECT 'TOTAL', COUNT(*), COUNT(DISTINCT key) FROM img"""))
def q_image_counts(spark, sf):
    from ..operators.images import image_counts
    return image_counts(_images(spark, sf))


@register("job_image_index", oracle(IMAGES_SQL + """
SELECT key, min(state_id) AS state_id, min(alias) AS alias, COUNT(*) AS images, min(file_id) AS first_file, max(file_id) AS last_file
FROM img GROUP BY key"""))
def q_job_image_index(spark, sf):
    from .jobs import job_image_index
    return job_image_index(_images(spark, sf))


LOOKUP_Q_SQL = """
, q AS (SELECT lower(clave) AS query FROM latest
        UNION ALL SELECT estado || '_' || clave FROM latest
        UNION ALL SELECT substring(clave, 1, 8) FROM latest
        UNION ALL SELECT clave || '-9' FROM latest),
  keys AS (SELECT DISTINCT key FROM img),
  al AS (SELECT lower(alias) AS alias, min(key) AS key FROM img WHERE alias IS NOT NULL GROUP BY 1),
  ex AS (SELECT q.query, k.key, 'exact' AS method FROM q JOIN keys k ON k.key = lower(trim(q.query))),
  r1 AS (SELECT * FROM q WHERE query NOT IN (SELECT query FROM ex)),
  ea AS (SELECT r1.query, al.key, 'alias' AS method FROM r1 JOIN al ON al.alias = lower(trim(r1.query))),
  r2 AS (SELECT * FROM r1 WHERE query NOT IN (SELECT query FROM ea)),
  pc AS (SELECT r2.query, arg_min(k.key, (abs(length(k.key) - length(lower(trim(r2.query)))), k.key)) AS key, 'partial' AS method
         FROM r2 JOIN keys k ON contains(k.key, lower(trim(r2.query))) OR contains(lower(trim(r2.query)), k.key)
         WHERE length(lower(trim(r2.query))) > 0 GROUP BY r2.query),
  f AS (SELECT * FROM ex UNION ALL SELECT * FROM ea UNION ALL SELECT * FROM pc)
"""


@register("image_lookup_cascade", ol(IMAGES_SQL + LOOKUP_Q_SQL + "SELECT q.query, f.key, f.method FROM q LEFT JOIN f USING (query)"))
def q_image_lookup_cascade(spark, sf):
    from ..operators.image_index import lookup
    l = _latest(spark, sf)
    q = (l.select(F.lower("clave").alias("query"))
         .unionByName(l.select(F.concat("estado", F.lit("_"), "clave").alias("query")))
         .unionByName(l.select(F.substring("clave", 1, 8).alias("query")))
         .unionByName(l.select(F.concat("clave", F.lit("-9")).alias("query"))))
    return lookup(q, _index(spark, sf))


@register("image_sync_merge", oracle(IMAGES_SQL + """
SELECT CASE WHEN mes > 8 THEN 'new' WHEN mes = 3 THEN 'updated' ELSE 'unchanged' END AS status, COUNT(*) AS files
FROM img GROUP BY 1"""))
def q_image_sync_merge(spark, sf):
    from ..operators.images import image_sync_merge
    imgs = _images(spark, sf)
    old = imgs.where(F.substring("modified", 6, 2).cast("int") <= 8)
    new = imgs.withColumn("modified", F.when(F.substring("modified", 6, 2) == "03",
                                             F.concat(F.substring("modified", 1, 5), F.lit("03-15")))
                          .otherwise(F.col("modified")))
    return image_sync_merge(old, new)[1]


FOLDER_NAMES = [a for a, _ in __import__("tessera.operators.images", fromlist=["x"]).STATE_FOLDER_ALIASES]


@register("alias_dim_match", oracle(f"""
, f AS (SELECT DISTINCT estado_id, CASE WHEN estado_id % 5 = 4 THEN 'Estado_' || CAST(estado_id AS VARCHAR)
                                       ELSE [{", ".join(f"'{a}'" for a in FOLDER_NAMES)}][estado_id + 1] END AS folder FROM panel),
  al AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {i})" for a, i in __import__("tessera.operators.images", fromlist=["x"]).STATE_FOLDER_ALIASES)}) v(alias, state_id))
SELECT f.folder, al.state_id, s.dim_name AS state FROM f LEFT JOIN al ON al.alias = f.folder LEFT JOIN {STATES_SQL} s ON s.dim_id = al.state_id"""))
def q_alias_dim_match(spark, sf):
    from ..operators.images import alias_dim_match
    names = F.array(*[F.lit(a) for a in FOLDER_NAMES])
    f = panel(spark, sf).select("estado_id").distinct().select(
        F.when(F.col("estado_id") % 5 == 4, F.concat(F.lit("Estado_"), F.col("estado_id").cast("string")))
         .otherwise(F.element_at(names, F.col("estado_id") + 1)).alias("folder"))
    matched, unmatched = alias_dim_match(spark, f, "folder")
    return matched.select("folder", "state_id", "state").unionByName(
        unmatched.select("folder", F.lit(None).cast("int").alias("state_id"), F.lit(None).cast("string").alias("state")))


# ------------------------------------------------------------------- period index / catalog
def _period_index_docs(spark, sf) -> str:
    """Two period-index documents derived from the panel's periods: even months wrapped under
    ``index``, odd months at the root. Months 4 and 12 carry no URL."""
    import uuid
    from ..session import scratch_path
    per = panel(spark, sf).select("anio", "mes").distinct()
    key = F.concat(F.col("anio").cast("string"), F.lit("-"), F.lpad(F.col("mes").cast("string"), 2, "0"))
    val = F.struct(F.concat(F.lit("panel_"), key, F.lit(".parquet")).alias("name"),
                   F.concat(F.lit("f"), F.col("anio").cast("string"), F.col("mes").cast("string")).alias("id"),
                   F.when(F.col("mes") % 4 != 0, F.concat(F.lit("https://files.example/d/"), key)).alias("download_url"),
                   F.when(F.col("mes") == 8, F.concat(F.lit("https://files.example/v/"), key)).alias("view_url"))
    e = per.select("anio", F.struct(key.alias("k"), val.alias("v")).alias("e"))
    base = scratch_path(spark, f"pindex-{uuid.uuid4().hex[:12]}")
    # one entry per month: the map is small by construction
    e.where("mes % 2 = 0").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("index")))
                               .alias("value")).write.text(f"{base}/wrapped")
    e.where("mes % 2 = 1").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")) \
        .write.text(f"{base}/root")
    return base


PINDEX_SQL = """
, per AS (SELECT DISTINCT anio, mes, CAST(anio AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0') AS k FROM panel),
  docs AS (SELECT *, 'wrapped' AS doc FROM per WHERE mes % 2 = 0 UNION ALL SELECT *, 'root' FROM per WHERE mes % 2 = 1)
"""


@register("scan_period_index", oracle(PINDEX_SQL + """
SELECT k AS period, 'panel_' || k || '.parquet' AS name, 'f' || CAST(anio AS VARCHAR) || CAST(mes AS VARCHAR) AS file_id,
       CASE WHEN mes % 4 <> 0 THEN 'https://files.example/d/' || k ELSE 'https://files.example/v/' || k END AS url
FROM docs WHERE mes % 4 <> 0 OR mes = 8"""))
def q_scan_period_index(spark, sf):
    from ..sources.json_sources import scan_period_index
    base = _period_index_docs(spark, sf)
    return scan_period_index(spark, [f"{base}/wrapped", f"{base}/root"])[0]


@register("period_index_discarded", oracle(PINDEX_SQL + """
SELECT CAST(SUM(CASE WHEN mes % 4 = 0 AND mes <> 8 THEN 1 ELSE 0 END) AS BIGINT) AS discarded,
       CAST(SUM(CASE WHEN mes % 4 <> 0 OR mes = 8 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM docs"""))
def q_period_index_discarded(spark, sf):
    from ..sources.json_sources import scan_period_index
    base = _period_index_docs(spark, sf)
    return scan_period_index(spark, [f"{base}/wrapped", f"{base}/root"])[1]


@register("available_periods_with_index", oracle("""
, g AS (SELECT year, list_sort(list_distinct(list(month))) AS months FROM (
          SELECT CAST(anio AS INTEGER) AS year, CAST(mes AS INTEGER) AS month FROM panel WHERE anio < 2001
          UNION ALL SELECT CAST(anio AS INTEGER), CAST(mes AS INTEGER) FROM panel WHERE mes % 4 <> 0 OR mes = 8) GROUP BY year)
SELECT year, CAST(len(months) AS INTEGER) AS n_months,
       array_to_string(list_transform(months, lambda x: lpad(CAST(x AS VARCHAR), 2, '0')), ',') AS months
FROM g WHERE len(list_intersect(months, range(1, 13))) = 12 OR year = 2001"""))
def q_available_periods_with_index(spark, sf):
    """Local table holds years before 2001; the rest is known only from the period index."""
    from ..sources.json_sources import scan_period_index
    base = _period_index_docs(spark, sf)
    idx = scan_period_index(spark, [f"{base}/wrapped", f"{base}/root"])[0].select(
        F.substring("period", 1, 4).cast("int").alias("year"), F.substring("period", 6, 2).cast("int").alias("month"))
    return ag.available_periods(panel(spark, sf).where("anio < 2001"), B, current_year=2001, extra=idx)


def _catalog(spark, sf) -> str:
    import uuid
    from ..session import scratch_path
    g = panel(spark, sf).groupBy("anio", "mes").agg(F.count(F.lit(1)).alias("rows"))
    y, m = F.col("anio").cast("string"), F.lpad(F.col("mes").cast("string"), 2, "0")
    f = F.struct(F.concat(F.lit("panel_"), y, F.lit("_"), m, F.lit(".parquet")).alias("name"),
                 F.concat(F.lit("Año_"), y, F.lit("/panel_"), y, F.lit("_"), m, F.lit(".parquet")).alias("path"),
                 F.lit("file").alias("type"), F.col("rows").cast("string").alias("size"),
                 F.concat(y, F.lit("-"), m, F.lit("-28T00:00:00Z")).alias("modifiedTime"),
                 y.alias("year"), m.alias("month"))
    years = (g.groupBy("anio").agg(F.sort_array(F.collect_list(F.struct("mes", f.alias("f")))).alias("fs"))  # <= 12 per year
             .select(F.col("anio").cast("long").alias("pos"), F.concat(F.lit("Año_"), F.col("anio").cast("string")).alias("name"),
                     F.col("anio").cast("string").alias("path"), F.lit("folder").alias("type"),
                     F.transform("fs", lambda x: x["f"]).alias("children")))
    empty = spark.range(1).select(F.lit(1994).cast("long").alias("pos"), F.lit("Año_1994").alias("name"),
                                  F.lit("1994").alias("path"), F.lit("folder").alias("type"),
                                  F.array().cast(years.schema["children"].dataType).alias("children"))
    path = scratch_path(spark, f"catalog-{uuid.uuid4().hex[:12]}")
    years.unionByName(empty).write.json(path)
    return path


@register("scan_file_catalog", oracle("""
SELECT 'Año_' || CAST(anio AS VARCHAR) AS folder, 'panel_' || CAST(anio AS VARCHAR) || '_' || lpad(CAST(mes AS VARCHAR), 2, '0') || '.parquet' AS name,
       'Año_' || CAST(anio AS VARCHAR) || '/panel_' || CAST(anio AS VARCHAR) || '_' || lpad(CAST(mes AS VARCHAR), 2, '0') || '.parquet' AS path,
       COUNT(*) AS size, CAST(anio AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0') || '-28T00:00:00Z' AS modified,
       CAST(anio AS VARCHAR) AS year, lpad(CAST(mes AS VARCHAR), 2, '0') AS month
FROM panel GROUP BY anio, mes"""))
def q_scan_file_catalog(spark, sf):
    from ..sources.json_sources import scan_file_catalog
    return scan_file_catalog(spark, _catalog(spark, sf))[0]


@register("file_catalog_statistics", oracle("""
SELECT COUNT(*) AS files, array_to_string(list_sort(list_distinct(list(y))), ',') AS years,
       array_to_string(list_sort(list_distinct(list(m))), ',') AS months
FROM (SELECT DISTINCT CAST(anio AS VARCHAR) AS y, lpad(CAST(mes AS VARCHAR), 2, '0') AS m FROM panel)"""))
def q_file_catalog_statistics(spark, sf):
    from ..sources.json_sources import scan_file_catalog
    return scan_file_catalog(spark, _catalog(spark, sf))[1]


@register("source_freshness", oracle("""
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%d/%m/%Y') AS shown,
       strftime(CASE WHEN month(o_orderdate) = 12 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH END, '%d/%m/%Y') AS shown_reference,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') > 500 AS stale
FROM orders"""))
def q_source_freshness(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", pe.source_freshness("o_orderdate").alias("shown"),
                    pe.source_freshness("o_orderdate", reference_mode=True).alias("shown_reference"),
                    pe.is_stale("o_orderdate", "2001-09-01").alias("stale"))


@register("source_file_freshness", None)
def q_source_file_freshness(spark, sf):
    """A row per file of the given tables; SQL has no file times, tests compare with the file system."""
    from ..sources.freshness import file_freshness
    from ..sources.tables import TABLES
    return file_freshness(spark, [f"{sf.rstrip('/')}/{t}.parquet" for t in TABLES], as_of="2030-01-01")


# ------------------------------------------------------------------------- vocabularies
RENAME_COLS = ["clave", "nombre", "municipio", "localidad", "zona", "cn_total", "inc_total", "lat", "lng", "anio", "mes"]


@register("rename_short_to_long", oracle("""
SELECT clave AS "Clave_Plaza", nombre AS "Nombre_PC", municipio AS "Municipio", localidad AS "Localidad", zona AS "Coord. Zona",
       cn_total AS "CN_Tot_Acum", inc_total AS "Inc_Total", lat AS "Latitud", lng AS "Longitud", anio AS "Año", mes AS mes FROM panel"""))
def q_rename_short_to_long(spark, sf):
    from ..operators.schema import rename_short_to_long
    return rename_short_to_long(panel(spark, sf).select(*RENAME_COLS))


@register("rename_long_to_short", oracle(f"SELECT {', '.join(RENAME_COLS)} FROM panel"))
def q_rename_long_to_short(spark, sf):
    from ..operators.schema import rename_long_to_short, rename_short_to_long
    return rename_long_to_short(rename_short_to_long(panel(spark, sf).select(*RENAME_COLS)))


@register("facility_profile_struct", ol("""
SELECT clave AS general_clave, nombre AS general_nombre, situacion AS general_situacion, conectividad AS general_conectividad,
       estado AS location_estado, estado_id AS location_estado_id, zona AS location_zona, municipio AS location_municipio,
       localidad AS location_localidad, lat AS location_lat, lng AS location_lng, anio AS period_anio, mes AS period_mes,
       inc_total AS enrolment_inc_total, aten_total AS attendance_aten_total, cn_inicial AS certificates_cn_inicial,
       cn_prim AS certificates_cn_prim, cn_sec AS certificates_cn_sec, cn_total AS certificates_cn_total FROM latest"""))
def q_facility_profile_struct(spark, sf):
    from ..operators.schema import facility_profile_struct
    s = facility_profile_struct(_latest(spark, sf))
    return s.select(*[F.col(f"{c}.{f.name}").alias(f"{c}_{f.name}") for c in s.columns for f in s.schema[c].dataType.fields])


@register("decode_numeric_codes", ol(f"""
SELECT r.clave, COALESCE(g.dim_name, r.estado) AS estado, COALESCE(s.dim_name, r.situacion) AS situacion
FROM (SELECT clave, CASE WHEN estado_id % 2 = 0 THEN CAST(estado_id + 1 AS VARCHAR) ELSE estado END AS estado,
             CAST(situacion AS VARCHAR) AS situacion FROM latest) r
LEFT JOIN {STATES_SQL} g ON CAST(g.dim_id AS VARCHAR) = trim(r.estado)
LEFT JOIN {STATUSES_SQL} s ON CAST(s.dim_id AS VARCHAR) = trim(r.situacion)"""))
def q_decode_numeric_codes(spark, sf):
    from ..sources.json_sources import decode_numeric_codes
    rec = _latest(spark, sf).select(
        "clave", F.when(F.col("estado_id") % 2 == 0, (F.col("estado_id") + 1).cast("string")).otherwise(F.col("estado")).alias("estado"),
        F.col("situacion").cast("string").alias("situacion"))
    return decode_numeric_codes(rec, {"estado": "states", "situacion": "statuses"},
                                {"states": dims.states_dim(spark), "statuses": dims.statuses_dim(spark)})[0]


def _tree_v1(spark, sf) -> str:
    """Old-format folder tree derived from the whole panel: state > facility folder (name =
    key, alternating case) > one file per period (June files are not images; links in two
    styles)."""
    import uuid
    from ..session import scratch_path
    p = panel(spark, sf)
    fid = F.concat("clave", F.lit("_"), F.col("period_key").cast("string"))
    link = F.when(F.col("mes") % 2 == 0, F.concat(F.lit("https://drive.example/uc?id="), fid, F.lit("&export=download"))) \
        .otherwise(F.concat(F.lit("https://drive.example/file/"), fid, F.lit("?usp=drivesdk")))
    fname = F.concat(F.lit("foto_"), F.col("period_key").cast("string"), F.lit(".jpg"))
    f = F.struct(fname.alias("name"), F.lit("file").alias("type"),
                 F.when(F.col("mes") == 6, F.lit("application/pdf")).otherwise(F.lit("image/jpeg")).alias("mimeType"),
                 fid.alias("id"), F.concat("estado", F.lit("/"), "clave", F.lit("/"), fname).alias("path"),
                 link.alias("webContentLink"))
    folders = (p.groupBy("estado_id", "estado", "clave")
               .agg(F.sort_array(F.collect_list(F.struct("period_key", f.alias("f")))).alias("fs"))  # one per period
               .select("estado_id", "estado", "clave", F.struct(
                   F.when(F.col("estado_id") % 2 == 0, F.col("clave")).otherwise(F.lower("clave")).alias("name"),
                   F.lit("folder").alias("type"), F.lit(None).cast("string").alias("mimeType"), F.col("clave").alias("id"),
                   F.concat("estado", F.lit("/"), "clave").alias("path"), F.lit(None).cast("string").alias("webContentLink"),
                   F.transform("fs", lambda x: x["f"]).alias("children")).alias("folder")))
    per_state = folders.groupBy("estado_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = (folders.join(bounded_broadcast(per_state), "estado_id")  # one row per group, size-checked
             .withColumn("chunk", F.pmod(F.xxhash64("clave"), F.greatest(F.ceil(F.col("n") / 500), F.lit(1))))
             .groupBy("estado_id", "estado", "chunk")
             .agg(F.sort_array(F.collect_list(F.struct("clave", "folder"))).alias("fs"))
             .select((F.col("estado_id").cast("long") * (1 << 40) + F.col("chunk")).alias("pos"), F.col("estado").alias("name"),
                     F.lit("folder").alias("type"), F.col("estado_id").cast("string").alias("id"),
                     F.col("estado").alias("path"), F.transform("fs", lambda x: x["folder"]).alias("children")))
    path = scratch_path(spark, f"treev1-{uuid.uuid4().hex[:12]}")
    nodes.write.json(path)
    return path


V1_SQL = """
, v1 AS (SELECT lower(clave) AS key, 'foto_' || CAST(period_key AS VARCHAR) || '.jpg' AS name,
                CASE WHEN mes % 2 = 0 THEN 'https://drive.example/uc?id=' || clave || '_' || CAST(period_key AS VARCHAR)
                     ELSE 'https://drive.example/file/' || clave || '_' || CAST(period_key AS VARCHAR) END AS url,
                mes, period_key, clave, estado
         FROM panel)
"""


@register("scan_image_tree_v1", ol(V1_SQL + """
SELECT v1.key, v1.name, v1.url FROM v1 WHERE v1.mes <> 6 AND v1.key IN (SELECT lower(clave) FROM latest)"""))
def q_scan_image_tree_v1(spark, sf):
    from ..operators.images import flatten_tree_v1, scan_image_tree_v1
    ch = flatten_tree_v1(spark, _tree_v1(spark, sf))
    return scan_image_tree_v1(ch, _latest(spark, sf).select(F.col("clave").alias("key")))


@register("lookup_image_by_path", ol(V1_SQL + """
SELECT l.estado || '/' || l.clave || '/foto_' || CAST(p AS VARCHAR) || '.jpg' AS path,
       CASE WHEN v1.clave IS NOT NULL THEN 'https://drive.google.com/uc?id=' || v1.clave || '_' || CAST(p AS VARCHAR) || '&export=download' END AS url
FROM (SELECT *, UNNEST([period_key, period_key - 100]) AS p FROM latest) l
LEFT JOIN v1 ON v1.clave = l.clave AND v1.period_key = l.p"""))
def q_lookup_image_by_path(spark, sf):
    from ..operators.images import flatten_tree_v1, lookup_image_by_path
    ch = flatten_tree_v1(spark, _tree_v1(spark, sf))
    l = _latest(spark, sf).select("estado", "clave", F.explode(F.array("period_key", F.col("period_key") - 100)).alias("p"))
    paths = l.select(F.concat("estado", F.lit("/"), "clave", F.lit("/foto_"), F.col("p").cast("string"), F.lit(".jpg")).alias("path"))
    return lookup_image_by_path(ch, paths)


@register("incremental_image_sync", oracle(IMAGES_SQL + """
SELECT CASE WHEN mes > 8 THEN 'new' WHEN mes = 3 THEN 'updated' ELSE 'unchanged' END AS status, COUNT(*) AS files
FROM img GROUP BY 1"""))
def q_incremental_image_sync(spark, sf):
    """Two rescans of the image tree land as snapshots; the stream merges them in order and the
    status counts of the second merge are returned."""
    import uuid
    from ..session import scratch_path
    from ..streaming.image_changes import incremental_image_sync
    base = scratch_path(spark, f"imgsync-{uuid.uuid4().hex[:12]}")
    imgs = _images(spark, sf).drop("folder_order")
    imgs.where(F.substring("modified", 6, 2).cast("int") <= 8).write.parquet(f"{base}/snap/s1")
    imgs.withColumn("modified", F.when(F.substring("modified", 6, 2) == "03",
                                       F.concat(F.substring("modified", 1, 5), F.lit("03-15")))
                    .otherwise(F.col("modified"))).write.parquet(f"{base}/snap/s2")
    schema = spark.read.parquet(f"{base}/snap/s1").schema
    incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/_checkpoint")
    return spark.read.parquet(f"{base}/table_counts").where(F.col("snapshot") == "s2").select("status", "files")


DETAIL_MS = ["cn_inicial", "cn_prim", "cn_sec", "cn_total"]


@register("report_group_detail", ol(f"""
, r AS (SELECT * FROM latest WHERE estado = (SELECT min(estado) FROM latest)),
  m AS (SELECT municipio, COUNT(*) AS muni_facilities,
               {", ".join(f"CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS muni_sum_{c}" for c in DETAIL_MS)}
        FROM r GROUP BY municipio),
  ld AS (SELECT {", ".join(f"arg_min(COALESCE(trim(clave), 'N/D'), (-COALESCE({c}, 0), COALESCE(trim(clave), 'N/D'))) AS l_{c}" for c in DETAIL_MS)} FROM r)
SELECT COALESCE(trim(r.clave), 'N/D') AS facility, COALESCE(trim(r.nombre), 'N/D') AS name, r.municipio AS municipality,
       {", ".join(f"COALESCE(CAST(trunc(TRY_CAST(CAST(r.{c} AS VARCHAR) AS DOUBLE)) AS BIGINT), 0) AS {c}" for c in DETAIL_MS)},
       m.muni_facilities, {", ".join(f"m.muni_sum_{c}" for c in DETAIL_MS)},
       {", ".join(f"COALESCE(COALESCE(trim(r.clave), 'N/D') = (SELECT l_{c} FROM ld) AND (SELECT SUM({c}) FROM r) > 0, false) AS leads_{c}" for c in DETAIL_MS)}
FROM r LEFT JOIN m ON m.municipio = r.municipio"""))
def q_report_group_detail(spark, sf):
    from .reports import report_group_detail
    return report_group_detail(_latest(spark, sf), _first_group(spark, sf), DETAIL_MS, B)


# ------------------------------------------------------- second names of paired inventory rows
@register("furniture_sums", ol(f"""
SELECT {", ".join(f"CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS sum_{c}"
                  for c in ["inc_total", "aten_total", "lat"])} FROM latest"""))
def q_furniture_sums(spark, sf):
    return ag.coerced_sums(_latest(spark, sf), ["inc_total", "aten_total", "lat"])


@register("clean_string", oracle("""
SELECT clave, period_key, CASE WHEN lower(COALESCE(trim(conectividad), '')) IN ('nan','none','nat') THEN ''
                               ELSE COALESCE(trim(conectividad), '') END AS conect_clean FROM panel"""))
def q_clean_string(spark, sf):
    return panel(spark, sf).select("clave", "period_key", tx.clean_string("conectividad").alias("conect_clean"))


@register("parse_period_key", oracle("""
SELECT DISTINCT period_key, CAST(period_key // 100 AS INTEGER) AS year, lpad(CAST(period_key % 100 AS VARCHAR), 2, '0') AS month FROM panel"""))
def q_parse_period_key(spark, sf):
    y, m = pe.parse_period_key("period_key")
    return panel(spark, sf).select("period_key", y.alias("year"), m.alias("month")).distinct()


@register("month_name", oracle(f"""
SELECT DISTINCT mes, {pe.month_name_sql('mes')} AS name, {pe.month_name_sql('mes + 6')} AS name_shifted FROM panel"""))
def q_month_name(spark, sf):
    return panel(spark, sf).select("mes", pe.month_name("mes").alias("name"),
                                   pe.month_name(F.col("mes") + 6).alias("name_shifted")).distinct()


@register("format_delta", oracle(CMP + f"""
SELECT group_name, CASE WHEN cn_total_delta > 0 THEN '+' ELSE '' END || format('{{:,}}', cn_total_delta) AS delta_text,
       CASE WHEN cn_total_delta > 0 THEN 'positive' WHEN cn_total_delta < 0 THEN 'negative' ELSE 'neutral' END AS sign_class
FROM cg"""))
def q_format_delta(spark, sf):
    from ..functions.labels import delta_text, sign_class
    return _cmp(spark, sf).select("group_name", delta_text(F.col("cn_total_delta")).alias("delta_text"),
                                  sign_class(F.col("cn_total_delta")).alias("sign_class"))


@register("file_url", oracle(IMAGES_SQL + "SELECT file_id, 'https://drive.google.com/thumbnail?id=' || file_id || '&sz=w800' AS thumbnail FROM img"))
def q_file_url(spark, sf):
    from ..operators.images import file_url
    return _images(spark, sf).select("file_id", file_url("file_id").alias("thumbnail"))


@register("compare_trends", QUERIES["top3_growth_per_level"][1])
def q_compare_trends(spark, sf):
    return q_top3_growth(spark, sf)


PROFILE_MS = ["cn_inicial", "cn_prim", "cn_sec", "inc_total_raw"]


@register("measure_profile_columns", oracle(" UNION ALL ".join(
    f"""SELECT '{m}' AS measure, CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS total,
       CAST(SUM(CASE WHEN TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
       CAST(SUM(CASE WHEN TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM panel"""
    for m in PROFILE_MS)))
def q_measure_profile_columns(spark, sf):
    return ag.measure_profile_columns(panel(spark, sf), PROFILE_MS)


@register("measure_profile_top_groups", oracle(f"""
, g AS (SELECT estado, {", ".join(f"CAST(trunc(COALESCE(SUM(COALESCE(TRY_CAST(CAST({m} AS VARCHAR) AS DOUBLE), 0.0)), 0.0)) AS BIGINT) AS {m}" for m in PROFILE_MS)}
        FROM panel GROUP BY estado),
  u AS ({" UNION ALL ".join(f"SELECT estado, '{m}' AS measure, {m} AS total FROM g" for m in PROFILE_MS)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY total DESC, estado) AS pos FROM u)
SELECT * FROM r WHERE pos <= 10"""))
def q_measure_profile_top_groups(spark, sf):
    return ag.measure_profile_top_groups(panel(spark, sf), PROFILE_MS, B)


@register("compare_periods_group_filter", oracle(CMP + f"""
SELECT * FROM cg WHERE {_norm_sql('group_name')} = 'NATION_3'
UNION ALL SELECT * FROM cg WHERE {_norm_sql('group_name')} = 'NO SUCH GROUP'"""))
def q_compare_periods_group_filter(spark, sf):
    """Group-name filter (accent/case-insensitive); an unknown name gives no rows [D5]."""
    from . import compare as cp
    dim = _nation_dim(spark, sf)
    p = panel(spark, sf)
    return (cp.compare_by_group(p, P1, P2, dim, B, group_name="nation_3")
            .unionByName(cp.compare_by_group(p, P1, P2, dim, B, group_name="No such group")))


def _report_clean_sql() -> str:
    q = QUERIES["report_by_group"][1]
    q = q.replace("  SELECT estado_id,\n", "  SELECT CAST(estado_id AS BIGINT) AS estado_id,\n", 1)
    q = q.replace("COALESCE(nation.n_name, 'Estado_' || CAST(t.estado_id AS VARCHAR)) AS group_name",
                  "COALESCE(s.dim_name, 'Estado_' || CAST(t.estado_id AS VARCHAR)) AS group_name")
    q = q.replace("FROM t LEFT JOIN nation ON nation.n_nationkey = t.estado_id",
                  f"FROM t LEFT JOIN {STATES_SQL} s ON s.dim_id = t.estado_id")
    return q


@register("report_by_group_from_raw", _report_clean_sql())
def q_report_by_group_from_raw(spark, sf):
    """End to end on the canonical schema: the panel exported as a raw delimited file, cleaned
    by ``job_clean_panel`` into a period-partitioned table, then the per-group report with the
    fixed group dictionary (ids outside it show as 'Estado_<id>')."""
    import uuid
    from ..session import scratch_path
    from .jobs import job_clean_panel
    out = scratch_path(spark, f"clean-{uuid.uuid4().hex[:12]}")
    clean, _ = job_clean_panel(spark, _raw_csv(spark, sf), out_path=out)
    return reports.report_by_group(clean, dims.states_dim(spark), B)
