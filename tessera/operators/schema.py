"""Column vocabularies: short <-> long names, facility profile categories, schema detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short column name -> long (legacy) column name, in the reference's order.
SHORT_TO_LONG = (
    ("Cve-mes", "Cve-mes"), ("Mes", "Mes"), ("Clave_Edo", "Clave_Edo"), ("zona", "Coord. Zona"),
    ("municipio", "Municipio"), ("localidad", "Localidad"), ("colonia", "Colonia"), ("cp", "Cod_Post"),
    ("calle", "Calle"), ("num", "Num"), ("clave", "Clave_Plaza"), ("nombre", "Nombre_PC"),
    ("inc_inicial", "Inc_Inicial"), ("inc_prim", "Inc_Prim"), ("inc_sec", "Inc_Sec"), ("inc_total", "Inc_Total"),
    ("aten_inicial", "Aten_Inicial"), ("aten_prim", "Aten_Prim"), ("aten_sec", "Aten_Sec"),
    ("aten_total", "Aten_Total"), ("examenes", "Exámenes aplicados"), ("cn_inicial", "CN_Inicial_Acum"),
    ("cn_prim", "CN_Prim_Acum"), ("cn_sec", "CN_Sec_Acum"), ("cn_total", "CN_Tot_Acum"),
    ("certificados", "Cert_Emitidos"), ("tec_doc", "Tec_Doc"), ("pvs1", "Nom_PVS_1"), ("pvs2", "Nom_PVS_2"),
    ("tipo_local", "Tipo_local"), ("inst_aliada", "Inst_aliada"), ("arq_discap", "Arq_Discap."),
    ("conectividad", "Conect_Instalada"), ("tipo_conect", "Tipo_Conect"), ("lat", "Latitud"),
    ("lng", "Longitud"), ("eq_total", "Total de equipos de cómputo en la plaza"),
    ("eq_operan", "Equipos de cómputo que operan"), ("tipos_eq", "Tipos de equipos de cómputo"),
    ("imp_funcionan", "Impresoras que funcionan"),
    ("imp_suministros", "Impresoras con suministros (toner, hojas)"),
    ("srv_total", "Total de servidores en la plaza"),
    ("srv_operan", "Número de servidores que funcionan correctamente"),
    ("mesas", "Cuantas mesas funcionan"), ("sillas", "Cuantas sillas funcionan"),
    ("anaqueles", "Cuantos Anaqueles funcionan"), ("anio", "Año"),
)

# Facility profile categories and their (short) fields.
PROFILE_CATEGORIES = (
    ("general", ("clave", "nombre", "situacion", "tipo_local", "inst_aliada", "arq_discap", "conectividad",
                 "tipo_conect")),
    ("location", ("estado", "estado_id", "zona", "municipio", "localidad", "colonia", "calle", "num", "cp",
                  "lat", "lng")),
    ("period", ("anio", "mes")),
    ("enrolment", ("inc_inicial", "inc_prim", "inc_sec", "inc_total")),
    ("attendance", ("aten_inicial", "aten_prim", "aten_sec", "aten_total", "examenes")),
    ("certificates", ("cn_inicial", "cn_prim", "cn_sec", "cn_total", "certificados")),
    ("staff", ("tec_doc", "pvs1", "pvs2")),
    ("equipment", ("eq_total", "eq_operan", "tipos_eq", "imp_funcionan", "imp_suministros", "srv_total",
                   "srv_operan")),
    ("furniture", ("mesas", "sillas", "anaqueles")),
)


def rename_short_to_long(df: DataFrame) -> DataFrame:
    """Rename present short names to long names in one projection; helper ``mes`` dropped
    when the month code column exists."""
    m = dict(SHORT_TO_LONG)
    cols = [c for c in df.columns if not (c == "mes" and "Cve-mes" in df.columns)]
    return df.select(*[F.col(f"`{c}`").alias(m.get(c, c)) for c in cols])


def rename_long_to_short(df: DataFrame) -> DataFrame:
    m = {long: short for short, long in SHORT_TO_LONG}
    return df.select(*[F.col(f"`{c}`").alias(m.get(c, c)) for c in df.columns])


def facility_profile_struct(df: DataFrame, skip_absent: bool = True) -> DataFrame:
    """One struct column per category with the fields the table has (absent fields skipped,
    or kept as nulls when ``skip_absent`` is false); categories left empty are dropped."""
    have = set(df.columns)
    out = []
    for cat, fields in PROFILE_CATEGORIES:
        fs = [F.col(f).alias(f) for f in fields if f in have] if skip_absent else \
            [(F.col(f) if f in have else F.lit(None)).alias(f) for f in fields]
        if fs:
            out.append(F.struct(*fs).alias(cat))
    return df.select(*out)


def detect_schema_variant(columns: list[str]) -> str:
    """'short' when lat/lng are present, 'long' for Latitud/Longitud, else by Estado/Situación."""
    cs = set(columns)
    if {"lat", "lng"} <= cs:
        return "short"
    if {"Latitud", "Longitud"} <= cs:
        return "long"
    if "Estado" in cs or "Situación" in cs:
        return "long"
    return "short"


# Month-code column candidates, then month-name candidates, then year candidates.
MONTH_CODE_CANDIDATES = ("Cve-mes", "Cve_mes", "cve-mes", "cve_mes")
MONTH_CANDIDATES = ("Mes", "mes", "MES")
YEAR_CANDIDATES = ("Año", "anio", "Anio", "AÑO", "ano", "year")


def detect_period_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """(month column, year column). A month column must hold numbers: month-code names first,
    then month names with at least one numeric value (counted in one aggregate)."""
    cands = [c for c in MONTH_CODE_CANDIDATES if c in df.columns] + [c for c in MONTH_CANDIDATES if c in df.columns]
    month = None
    if cands:
        counts = df.agg(*[F.count(F.col(f"`{c}`").cast("string").try_cast("double")).alias(f"n{i}")
                          for i, c in enumerate(cands)]).first()
        month = next((c for i, c in enumerate(cands) if counts[f"n{i}"] > 0), None)
    year = next((c for c in YEAR_CANDIDATES if c in df.columns), None)
    if year is None:
        low = {c.lower(): c for c in df.columns}
        year = next((low[c.lower()] for c in YEAR_CANDIDATES if c.lower() in low), None)
    return month, year


def resolve_role(columns: list[str], aliases: dict[str, tuple], required: tuple) -> dict[str, str | None]:
    """Role -> column, matching after strip/lower/space,hyphen -> '_'; the first alias wins.
    Missing required roles raise; missing optional roles map to None."""
    def norm(s: str) -> str:
        return s.strip().lower().replace(" ", "_").replace("-", "_")
    by_norm = {}
    for c in columns:
        by_norm.setdefault(norm(c), c)
    out = {}
    for role, names in aliases.items():
        out[role] = next((by_norm[norm(n)] for n in names if norm(n) in by_norm), None)
        if out[role] is None and role in required:
            raise ValueError(f"required column for '{role}' not found")
    return out
