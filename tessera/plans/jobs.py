"""Batch jobs: raw delimited file -> canonical, typed, period-partitioned panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.period import period_key
from ..operators import clean
from ..sources.delimited import scan_delimited


def job_clean_panel(spark: SparkSession, raw_path: str, out_path: str | None = None,
                    sep: str | None = None) -> tuple[DataFrame, list[tuple]]:
    """Read a raw delimited file, resolve headers, type every field, add ``period_key``.
    Writes the partitioned panel when ``out_path`` is given. Returns (panel, alias report)."""
    from ..operators.schema import detect_period_columns
    raw = clean.trim_column_names(scan_delimited(spark, raw_path, sep))
    mapping, report = clean.resolve_aliases(raw.columns)
    report = report + [(None, c, "unknown") for c in raw.columns if c not in mapping]
    if "mes" not in mapping.values() or "anio" not in mapping.values():
        # no alias matched: fall back to the period-column detection (numeric month column)
        month, year = detect_period_columns(raw)
        for src, field in ((month, "mes"), (year, "anio")):
            if src and field not in mapping.values() and mapping.get(src) in (None, "mes_texto"):
                mapping[src] = field
    typed = clean.standardise_types(clean.apply_aliases(raw, mapping))
    typed = typed.withColumn("period_key", period_key("anio", "mes"))
    if out_path:
        from ..sources.panel import sink_panel_partitioned
        sink_panel_partitioned(typed, out_path, ("period_key",), "clave")
        typed = spark.read.parquet(out_path)
    return typed, report


def job_image_index(images: DataFrame) -> DataFrame:
    """Key index of a flattened image tree: state, alias, image count and the first / last file
    id (the file rows themselves stay in the flattened table; no per-key list is collected)."""
    return (images.groupBy("key")
            .agg(F.min("state_id").alias("state_id"), F.min("alias").alias("alias"),
                 F.count(F.lit(1)).alias("images"), F.min("file_id").alias("first_file"),
                 F.max("file_id").alias("last_file")))


# Accepted headers per role of the coordinate export, in order (case, spaces and
# hyphens do not count).
COORD_ROLES = {
    "key": ("Clave_Plaza", "clave", "CVE_PLAZA", "ID_PLAZA", "FOLIO"),
    "lat": ("Latitud", "lat", "LATITUD_DEC", "latitude", "Y", "y_coord", "COORD_Y"),
    "lng": ("Longitud", "lng", "lon", "LONGITUD_DEC", "longitude", "X", "x_coord", "COORD_X"),
    "period": ("Cve-mes", "PERIODO", "MES_CLAVE", "Año_Mes", "anio_mes", "YYYYMM"),
    "name": ("Nombre_PC", "Nombre", "NombrePlaza", "NOMBRE_PLAZA", "Name"),
    "group": ("Estado", "Entidad", "Estado_Plaza", "CVE_EDO", "Clave_Edo"),
    "municipality": ("Municipio", "Mpio", "Municipio_Plaza"),
    "locality": ("Localidad", "Loc", "Localidad_Plaza"),
    "status": ("Situación", "Situacion", "Estatus", "Status", "Estado_Operacion"),
}


def job_export_coordinates(raw: DataFrame, order_col: str):
    """Raw table -> validated unique coordinates, rejects and counters; columns found by role. With a
    period column, only the rows of its largest number go on (all rows if it holds no number)."""
    from ..functions.numbers import to_number
    from ..operators.schema import resolve_role
    roles = resolve_role(raw.columns, COORD_ROLES, required=("key", "lat", "lng"))
    if roles["period"]:
        number = to_number(F.col(f"`{roles['period']}`"))
        newest = raw.agg(F.max(number)).scalar()
        raw = raw.where(newest.isNull() | (number == newest))
    extra = tuple(roles[r] for r in ("name", "group", "municipality", "locality", "status") if roles[r])
    return clean.export_coordinates(raw, roles["key"], roles["lat"], roles["lng"], order_col, extra)
