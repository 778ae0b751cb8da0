"""Code dictionaries (group ids, statuses) and the joins that decode/encode them.

Dictionaries are small and fixed (32 groups, 5 statuses), so they are broadcast; dimension
frames supplied by the caller go through ``bounded_broadcast`` (size checked first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_text, norm_text_lit
from ..sources.tables import bounded_broadcast, literal_rows

# Group (state) id -> official name.
STATES = (
    (1, "Aguascalientes"), (2, "Baja California"), (3, "Baja California Sur"), (4, "Campeche"),
    (5, "Coahuila"), (6, "Colima"), (7, "Chiapas"), (8, "Chihuahua"), (9, "Ciudad de México"),
    (10, "Durango"), (11, "Guanajuato"), (12, "Guerrero"), (13, "Hidalgo"), (14, "Jalisco"),
    (15, "México"), (16, "Michoacán"), (17, "Morelos"), (18, "Nayarit"), (19, "Nuevo León"),
    (20, "Oaxaca"), (21, "Puebla"), (22, "Querétaro"), (23, "Quintana Roo"),
    (24, "San Luis Potosí"), (25, "Sinaloa"), (26, "Sonora"), (27, "Tabasco"),
    (28, "Tamaulipas"), (29, "Tlaxcala"), (30, "Veracruz"), (31, "Yucatán"), (32, "Zacatecas"),
)

# Status code -> label.
STATUSES = (
    (0, "SUSPENSIÓN TEMPORAL"), (1, "EN OPERACIÓN"), (2, "EN PROCESO DE APERTURA"),
    (3, "BAJA DEFINITIVA"), (4, "REUBICACIÓN"),
)

# Upper-case spellings of the exact state encoder; the id is the 1-based position.
STATE_ENCODE_EXACT = (
    "AGUASCALIENTES", "BAJA CALIFORNIA", "BAJA CALIFORNIA SUR", "CAMPECHE", "COAHUILA", "COLIMA",
    "CHIAPAS", "CHIHUAHUA", "CIUDAD DE MÉXICO", "DURANGO", "GUANAJUATO", "GUERRERO", "HIDALGO",
    "JALISCO", "MEXICO", "MICHOACAN", "MORELOS", "NAYARIT", "NUEVO LEON", "OAXACA", "PUEBLA",
    "QUERETARO", "QUINTANA ROO", "SAN LUIS POTOSI", "SINALOA", "SONORA", "TABASCO", "TAMAULIPAS",
    "TLAXCALA", "VERACRUZ", "YUCATAN", "ZACATECAS",
)


def states_dim(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, STATES, "dim_id", "dim_name")


def statuses_dim(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, STATUSES, "dim_id", "dim_name")


def as_dim(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Any (id, name) frame as a dictionary with the canonical column names."""
    return df.select(F.col(id_col).alias("dim_id"), F.col(name_col).alias("dim_name"))


def dim_decode(df: DataFrame, code_col: str, dim: DataFrame, out: str, unknown_prefix: str) -> DataFrame:
    """id -> name via a left broadcast join; unmatched -> '<prefix><id>', null id -> ''."""
    d = bounded_broadcast(dim.select("dim_id", "dim_name"))
    j = df.join(d, df[code_col] == d["dim_id"], "left")
    name = (F.when(F.col(code_col).isNull(), F.lit(""))
            .otherwise(F.coalesce(F.col("dim_name"),
                                  F.concat(F.lit(unknown_prefix), F.col(code_col).cast("string")))))
    return j.withColumn(out, name).drop("dim_id", "dim_name")


def state_id_of(text_col: str) -> Column:
    """State text -> id by the fixed spellings, accents and case folded; unmatched -> null."""
    names = {norm_text_lit(n): i + 1 for i, n in reversed(list(enumerate(STATE_ENCODE_EXACT)))}
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(pairs, norm_text(text_col))


def dim_encode(df: DataFrame, text_col: str, out: str, spark: SparkSession,
               accent_insensitive: bool = True) -> DataFrame:
    """State text -> id; unmatched -> 0. Exact mode compares trim/upper with the fixed spellings
    (so 'México' -> 0, as in the reference); the default also folds accents on both sides."""
    d = spark.createDataFrame([(i + 1, n) for i, n in enumerate(STATE_ENCODE_EXACT)],
                              "enc_id int, enc_name string")
    if accent_insensitive:
        d = d.select("enc_id", norm_text("enc_name").alias("enc_name"))
        key = norm_text(text_col)
    else:
        key = F.upper(F.trim(F.col(text_col)))
    j = df.withColumn("__enc_key", key).join(F.broadcast(d), F.col("__enc_key") == F.col("enc_name"), "left")
    return j.withColumn(out, F.coalesce(F.col("enc_id"), F.lit(0))).drop("__enc_key", "enc_id", "enc_name")


def derive_dim_from_data(df: DataFrame, id_col: str, name_col: str, order_col: str | None = None) -> DataFrame:
    """id -> name map from the data: non-numeric ids and blank/nan/none names dropped; the last
    pair (by ``order_col``, else by name) wins. Pre-aggregated by (id, name) before the per-id
    reduction, so a hot id never concentrates raw rows in one task."""
    ids = F.col(id_col).cast("string").try_cast("double").try_cast("int")
    nm = F.trim(F.col(name_col).cast("string"))
    clean = (df.select(ids.alias("dim_id"), nm.alias("dim_name"),
                       (F.col(order_col) if order_col else F.lit(0)).alias("__ord"))
             .where(F.col("dim_id").isNotNull() & F.col("dim_name").isNotNull()
                    & ~F.lower(F.col("dim_name")).isin("", "nan", "none")))
    pairs = clean.groupBy("dim_id", "dim_name").agg(F.max("__ord").alias("__ord"))
    return (pairs.groupBy("dim_id")
            .agg(F.max_by("dim_name", F.struct("__ord", "dim_name")).alias("dim_name")))


def dim_merge_precedence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two id->name maps; names from ``first`` win."""
    u = (first.select("dim_id", "dim_name", F.lit(0).alias("__p"))
         .unionByName(second.select("dim_id", "dim_name", F.lit(1).alias("__p"))))
    return u.groupBy("dim_id").agg(F.min_by("dim_name", "__p").alias("dim_name"))


def canonical_group_name(df: DataFrame, group_col: str, spelling: str) -> DataFrame:
    """Display spelling(s) whose normalised form equals the user's spelling."""
    q = norm_text_lit(spelling)
    return (df.select(F.col(group_col).alias("group_name"))
            .where(norm_text(group_col) == F.lit(q)).distinct())
