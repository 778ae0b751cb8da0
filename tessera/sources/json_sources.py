"""JSON inputs: coordinate records, the period index, folder trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .prepared import path_exists
from .tables import bounded_broadcast


def scan_coordinates_json(spark: SparkSession, path: str, text_fields: list[str], multiline: bool = False) -> DataFrame:
    """Coordinate records: JSON lines of records, or with ``multiline`` documents that each are one list
    (``scan_coordinate_documents``). Records whose lat/lng do not parse are skipped, missing text becomes
    '', coordinates rounded to 6."""
    if multiline:
        return scan_coordinate_documents(spark, path, text_fields)
    fields = ", ".join(f"{f} string" for f in ["clave", "lat", "lng", *text_fields])
    df = spark.read.schema(fields).json(path)
    la, lo = F.col("lat").try_cast("double"), F.col("lng").try_cast("double")
    return (df.where(la.isNotNull() & lo.isNotNull())
            .select(F.coalesce("clave", F.lit("")).alias("clave"), F.round(la, 6).alias("lat"),
                    F.round(lo, 6).alias("lng"), *[F.coalesce(f, F.lit("")).alias(f) for f in text_fields]))


def _variant_text(item: str, field: str) -> Column:
    """A field as text: '' if it is absent, null, false, zero or empty; true as 'True'."""
    v = F.try_variant_get(F.col(item), f"$.{field}", "variant")
    kind, text = F.schema_of_variant(v), F.try_variant_get(F.col(item), f"$.{field}", "string")
    nothing = v.isNull() | F.is_variant_null(v) | ((kind != "STRING") & (text.isin("false", "[]", "{}") | (text.try_cast("double") == 0)))
    return F.coalesce(F.when(nothing, "").when(kind == "BOOLEAN", "True").otherwise(text), F.lit(""))


def _variant_number(item: str, field: str) -> Column:
    """A field as a number: numbers, texts that are one, true and false as 1 and 0; else null."""
    text = F.try_variant_get(F.col(item), f"$.{field}", "string")
    is_bool = F.schema_of_variant(F.try_variant_get(F.col(item), f"$.{field}", "variant")) == "BOOLEAN"
    return F.when(is_bool, (text == "true").cast("double")).otherwise(F.trim(text).try_cast("double"))


def scan_coordinate_documents(spark: SparkSession, path: str, text_fields: list[str]) -> DataFrame:
    """Coordinate records of JSON documents. A document counts only as a whole: it has to be a list with
    at least one item, all items objects, the first of them with the keys lat and lng; else it gives
    nothing. In a good document, items whose lat or lng is no number are skipped. A path that is not
    there gives nothing. A document is one row by nature."""
    columns = ["clave", *text_fields]
    if not path_exists(spark, path):
        return spark.createDataFrame([], "clave string, lat double, lng double" + "".join(f", {f} string" for f in text_fields))
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    has = lambda key: F.try_variant_get("doc", f"$[0].{key}", "variant").isNotNull()
    lists = docs.where(F.schema_of_variant("doc").startswith("ARRAY") & has("lat") & has("lng"))
    items = lists.select(F.try_variant_get("doc", "$", "array<variant>").alias("items")).where(
        F.forall("items", lambda x: F.schema_of_variant(x).startswith("OBJECT"))).select(F.explode("items").alias("x"))
    la, lo = _variant_number("x", "lat"), _variant_number("x", "lng")
    return items.where(la.isNotNull() & lo.isNotNull()).select(
        _variant_text("x", columns[0]).alias(columns[0]), F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lng"),
        *[_variant_text("x", f).alias(f) for f in text_fields])


PERIOD_ENTRY = "struct<name:string,id:string,download_url:string,view_url:string,url:string>"


def scan_period_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Period index documents: a map 'YYYY-MM' -> file info, under ``index`` or at the root.
    Entries with any of download_url / view_url / url are kept; returns (entries, discarded
    count per document). Each document is one small map (one entry per month)."""
    doc = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "map<string,string>")
    d = doc.select(top.alias("top"))
    raw = (F.when(F.col("top").getItem("index").isNotNull(), F.col("top").getItem("index"))
           .when(F.try_element_at(F.map_keys("top"), F.lit(1)).rlike(r"^\d{4}-"), F.to_json("top")))
    m = F.from_json(raw, f"map<string,string>")
    e = (d.select(F.posexplode(m).alias("doc_entry", "period", "v"))
         .select("period", F.from_json("v", PERIOD_ENTRY).alias("x")))
    ok = F.col("x").isNotNull() & F.coalesce(F.col("x.download_url"), F.col("x.view_url"), F.col("x.url")).isNotNull()
    entries = e.where(ok).select("period", F.col("x.name").alias("name"), F.col("x.id").alias("file_id"),
                                 F.coalesce("x.download_url", "x.view_url", "x.url").alias("url"))
    discarded = e.agg(F.count_if(~ok).cast("bigint").alias("discarded"), F.count_if(ok).cast("bigint").alias("kept"))
    return entries, discarded


CATALOG_FILE = ("struct<name:string,path:string,type:string,size:string,modifiedTime:string,year:string,"
                "month:string,download_url:string,view_url:string>")
CATALOG_YEAR = f"pos long, name string, path string, type string, children array<{CATALOG_FILE}>"


def scan_file_catalog(spark: SparkSession, path: str, whole_document: bool = False) -> tuple[DataFrame, DataFrame]:
    """Folder tree of monthly files (JSON lines of year folders, or one document that holds them under
    ``structure.children``) -> one row per file, and the statistics block (file count, sorted
    distinct years and months)."""
    if whole_document:
        doc = spark.read.schema(f"structure struct<children: array<struct<{CATALOG_YEAR.replace('pos long, ', '').replace(' string', ': string').replace('children array', 'children: array')}>>>")
        years = doc.option("multiLine", True).json(path).select(F.explode("structure.children").alias("y")).select("y.*")
    else:
        years = spark.read.schema(CATALOG_YEAR).json(path)
    files = (years.select(F.col("name").alias("folder"), F.explode("children").alias("f"))
             .select("folder", "f.name", "f.path", F.col("f.size").try_cast("bigint").alias("size"),
                     F.col("f.modifiedTime").alias("modified"), F.col("f.year").alias("year"),
                     F.col("f.month").alias("month")))
    stats = files.agg(F.count(F.lit(1)).alias("files"),
                      F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"),
                      F.array_join(F.sort_array(F.collect_set("month")), ",").alias("months"))
    return files, stats


def decode_numeric_codes(records: DataFrame, code_cols: dict, dims: dict) -> tuple[DataFrame, DataFrame]:
    """Replace numeric codes stored as text (e.g. '15') by names through broadcast
    dictionaries; returns (records, number of records changed)."""
    out, changed = records, F.lit(False)
    for col, name in code_cols.items():
        d = bounded_broadcast(dims[name].select(F.col("dim_id").cast("string").alias(f"__c_{col}"),
                                          F.col("dim_name").alias(f"__n_{col}")))
        out = out.join(d, F.trim(out[col]) == F.col(f"__c_{col}"), "left")
        changed = changed | F.col(f"__n_{col}").isNotNull()
        out = out.withColumn(col, F.coalesce(F.col(f"__n_{col}"), F.col(col)))
    out = out.withColumn("__changed", changed)
    n = out.agg(F.count_if("__changed").cast("bigint").alias("changed"))
    return out.drop(*[c for c in out.columns if c.startswith("__")]), n
