"""Image catalogue: flatten folder trees, index by facility key, look keys up, merge rescans.

The tree is read with a declared schema (no inference). A tree stored as JSON lines of
state nodes is split across tasks; the reference's single-document form (``multiLine``) is a
single record by nature and is only read that way when given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import KEY_PATTERN, normalise_facility_key
from ..session import scratch_path

FILE_T = T.StructType([T.StructField(n, t) for n, t in (
    ("i", T.StringType()), ("id", T.StringType()), ("n", T.StringType()), ("name", T.StringType()),
    ("s", T.LongType()), ("size", T.LongType()), ("m", T.StringType()), ("mediumUrl", T.StringType()),
    ("thumbnailUrl", T.StringType()), ("directUrl", T.StringType()))])
FOLDER_T = T.StructType([T.StructField("k", T.StringType()), T.StructField("name", T.StringType()),
                         T.StructField("alias", T.StringType()), T.StructField("type", T.StringType()),
                         T.StructField("children", T.ArrayType(FILE_T))])
STATE_T = T.StructType([T.StructField("pos", T.LongType()),
                        T.StructField("id", T.IntegerType()), T.StructField("estado", T.StringType()),
                        T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
                        T.StructField("children", T.ArrayType(FOLDER_T))])
TREE_T = T.StructType([T.StructField("generated_at", T.StringType()),
                       T.StructField("structure", T.StructType([T.StructField("name", T.StringType()),
                                                                T.StructField("children", T.ArrayType(STATE_T))]))])

# Thumbnail link template of a file id.
THUMBNAIL_URL = "https://drive.google.com/thumbnail?id={}&sz=w800"


def file_url(file_id) -> Column:
    c = F.col(file_id) if isinstance(file_id, str) else file_id
    pre, post = THUMBNAIL_URL.split("{}")
    return F.concat(F.lit(pre), c, F.lit(post))


def key_alias(original: Column, key: Column) -> Column:
    """Alias kept when the folder name is decorated (differs from its key) or has no key."""
    o = F.trim(original)
    return F.when(~o.rlike(KEY_PATTERN) | (F.lower(o) != key), o)


def read_state_nodes(spark: SparkSession, path: str, whole_document: bool = False) -> DataFrame:
    """State nodes with their position: JSON lines of state nodes, or one whole tree document."""
    if whole_document:
        doc = spark.read.schema(TREE_T).option("multiLine", True).json(path)
        return doc.select(F.posexplode("structure.children").alias("state_pos", "s")).select("state_pos", "s.*")
    nodes = spark.read.schema(STATE_T).json(path)
    return nodes.select(F.coalesce(F.col("pos"), F.col("id").cast("long"), F.lit(0)).alias("state_pos"), "*")


def scan_image_tree(states: DataFrame) -> DataFrame:
    """Flatten to one row per image: (state id/name, folder order, key, alias, file id, name,
    url, size, modified). Key = ``k`` or the normalised folder ``name``; url = first of
    medium/thumbnail/direct link else the template; files without id or url are dropped, so
    folders without files disappear; when a key occurs in several folders the last one wins."""
    folders = states.select(F.col("id").alias("state_id"), F.col("estado").alias("state"), "state_pos",
                            F.posexplode("children").alias("folder_pos", "f"))
    key = F.coalesce(F.col("f.k"), normalise_facility_key(F.coalesce(F.col("f.name"), F.lit(""))))
    alias = F.coalesce(F.col("f.alias"), F.when(F.col("f.k").isNull(), key_alias(F.col("f.name"), key)))
    named = folders.select("state_id", "state", F.struct("state_pos", "folder_pos").alias("folder_order"),
                           key.alias("key"), alias.alias("alias"), "f.children").where(F.col("key") != "")
    files = (named.select("state_id", "state", "folder_order", "key", "alias", F.explode("children").alias("x"))
             .select("state_id", "state", "folder_order", "key", "alias",
                     F.coalesce("x.i", "x.id").alias("file_id"), F.coalesce("x.n", "x.name").alias("file_name"),
                     F.coalesce("x.s", "x.size").alias("size"), F.col("x.m").alias("modified"),
                     F.coalesce("x.mediumUrl", "x.thumbnailUrl", "x.directUrl").alias("link"))
             .withColumn("url", F.coalesce(F.col("link"), file_url(F.col("file_id"))))
             .where(F.col("file_id").isNotNull() & F.col("url").isNotNull())
             .drop("link"))
    return files.join(_replaced_folders(named), ["key", "folder_order"], "left_anti")


def _replaced_folders(named: DataFrame) -> DataFrame:
    """key, folder_order of the folders with files whose key a later such folder has too. Found among the
    folders and written first: their size is then known when the files meet them, and while they are few,
    as in most trees, the files (the bulk) are not shuffled for it."""
    spark = named.sparkSession
    holding = named.where(F.exists("children", lambda x: F.coalesce(x["i"], x["id"]).isNotNull())).select("key", "folder_order")
    last = holding.groupBy("key").agg(F.max("folder_order").alias("last"), F.min("folder_order").alias("first"))
    several = last.where(F.col("first") < F.col("last")).select("key", "last")
    path = scratch_path(spark, f"replaced-{uuid.uuid4().hex}")
    holding.join(several, "key").where(F.col("folder_order") < F.col("last")).select("key", "folder_order").distinct().write.parquet(path)
    return spark.read.schema(holding.schema).parquet(path)


def alias_index(images: DataFrame) -> DataFrame:
    """lower(alias) -> key, one row per alias (last folder wins, as for keys)."""
    a = images.where(F.col("alias").isNotNull()).select(F.lower("alias").alias("alias"), "key", "folder_order")
    return a.groupBy("alias").agg(F.max_by("key", "folder_order").alias("key"))


def image_lookup_cascade(queries: DataFrame, images: DataFrame, q_col: str = "query") -> DataFrame:
    """(query, key, method) per row of ``queries`` through the look-up tables of ``images`` (key, alias,
    folder_order), written for this call; ``image_index`` keeps them for a tree. See ``image_index.lookup``."""
    from .image_index import lookup, write_lookup
    return lookup(queries, write_lookup(images, scratch_path(images.sparkSession, f"lookup-{uuid.uuid4().hex}")), q_col)


def image_counts(images: DataFrame) -> DataFrame:
    """Images and folders per state, plus one TOTAL row."""
    g = images.groupBy("state").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("key").alias("folders"))
    t = images.agg(F.lit("TOTAL").alias("state"), F.count(F.lit(1)).alias("images"),
                   F.count_distinct("key").alias("folders"))
    return g.unionByName(t)


def image_sync_merge(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rescan merge on file id: same modified date (or none in both) -> cached name/size kept, else
    the new ones. Presence in a scan is the file's row, not its date. Returns (merged files of the new scan, counts of new / updated / unchanged / removed)."""
    o = old.select(F.col("file_id"), F.col("file_name").alias("o_name"), F.col("size").alias("o_size"),
                   F.col("modified").alias("o_m"), F.lit(True).alias("o_there"))
    j = new.withColumn("n_there", F.lit(True)).join(o, "file_id", "full")
    status = (F.when(F.col("o_there").isNull(), "new").when(F.col("n_there").isNull(), "removed")
              .when(F.col("o_m").eqNullSafe(F.col("modified")), "unchanged").otherwise("updated"))
    j = j.withColumn("status", status)
    same = F.col("status") == "unchanged"
    merged = (j.where(F.col("status") != "removed")
              .withColumn("file_name", F.when(same, F.col("o_name")).otherwise(F.col("file_name")))
              .withColumn("size", F.when(same, F.col("o_size")).otherwise(F.col("size")))
              .drop("o_name", "o_size", "o_m", "o_there", "n_there", "status"))
    counts = j.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    return merged, counts


# State folder spellings -> state id.
STATE_FOLDER_ALIASES = (
    ("Aguascalientes", 1), ("Baja California", 2), ("Baja California Sur", 3), ("Campeche", 4),
    ("Coahuila", 5), ("Colima", 6), ("Chiapas", 7), ("Chihuahua", 8), ("CDMX", 9), ("Ciudad de México", 9),
    ("Durango", 10), ("Guanajuato", 11), ("Guerrero", 12), ("Hidalgo", 13), ("Jalisco", 14),
    ("Estado de México", 15), ("México", 15), ("Estado Mexico", 15), ("Michoacán", 16), ("Morelos", 17),
    ("Nayarit", 18), ("Nuevo León", 19), ("Nuevo Leon", 19), ("Oaxaca", 20), ("Puebla", 21),
    ("Querétaro", 22), ("Queretaro", 22), ("Quintana Roo", 23), ("San Luis Potosí", 24),
    ("San Luis Potosi", 24), ("Sinaloa", 25), ("Sonora", 26), ("Tabasco", 27), ("Tamaulipas", 28),
    ("Tlaxcala", 29), ("Veracruz", 30), ("Yucatán", 31), ("Yucatan", 31), ("Zacatecas", 32),
)


def alias_dim_match(spark: SparkSession, folders: DataFrame, name_col: str = "folder") -> tuple[DataFrame, DataFrame]:
    """Folder name -> (state id, canonical name) through the alias table (exact spelling);
    returns (matched, unmatched)."""
    from .dims import STATES
    al = spark.createDataFrame(list(STATE_FOLDER_ALIASES), "alias string, state_id int")
    canon = spark.createDataFrame(list(STATES), "state_id int, state string")
    dim = F.broadcast(al.join(canon, "state_id"))  # 39 + 32 fixed rows
    j = folders.join(dim, folders[name_col] == dim["alias"], "left")
    return (j.where(F.col("state_id").isNotNull()).drop("alias"),
            j.where(F.col("state_id").isNull()).select(name_col))


# ------------------------------------------------------------------ old (v1) folder tree
V1_FILE = ("struct<name:string,type:string,mimeType:string,id:string,path:string,webContentLink:string>")
V1_FOLDER = f"struct<name:string,type:string,id:string,path:string,children:array<{V1_FILE}>>"
V1_STATE = (f"pos long, name string, type string, id string, path string, "
            f"children array<struct<name:string,type:string,mimeType:string,id:string,path:string,"
            f"webContentLink:string,children:array<{V1_FILE}>>>")


def flatten_tree_v1(spark: SparkSession, path: str, whole_document: bool = False) -> DataFrame:
    """Old tree (JSON lines of state nodes, or one document that holds them under
    ``structure.children``; depth state > folder > file) -> one row per child of every folder,
    with the folder's depth-first order and lower-cased name."""
    if whole_document:
        node = spark.range(0).select(F.from_json(F.lit(None).cast("string"), V1_STATE).alias("s")).schema["s"].dataType
        tree = T.StructType([T.StructField("structure", T.StructType([T.StructField("children", T.ArrayType(node))]))])
        doc = spark.read.schema(tree).option("multiLine", True).json(path)
        st = doc.select(F.posexplode("structure.children").alias("at", "s")).select("s.*", "at").withColumn("pos", F.col("at").cast("long")).drop("at")
    else:
        st = spark.read.schema(V1_STATE).json(path)
    state_level = st.select(F.struct(F.col("pos").alias("s"), F.lit(-1).alias("f")).alias("order"), F.lower("name").alias("folder"),
                            F.col("type").alias("folder_type"), F.explode("children").alias("c"))
    sub = (st.select("pos", F.posexplode("children").alias("fp", "f"))
           .where(F.col("f.type") == "folder")
           .select(F.struct(F.col("pos").alias("s"), F.col("fp").alias("f")).alias("order"), F.lower("f.name").alias("folder"),
                   F.col("f.type").alias("folder_type"), F.explode("f.children").alias("c")))
    cols = ["order", "folder", "folder_type", F.col("c.name").alias("name"), F.col("c.type").alias("type"),
            F.col("c.mimeType").alias("mime"), F.col("c.id").alias("id"), F.col("c.path").alias("path"),
            F.col("c.webContentLink").alias("link")]
    return state_level.select(*cols).unionByName(sub.select(*cols))


def scan_image_tree_v1(children: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Images of the first folder (depth-first) whose lower-cased name equals each key: image
    files with a link, '&export=download' and '?usp=drivesdk' removed."""
    folders = children.where(F.col("folder_type") == "folder").select("order", "folder").distinct()
    k = keys.select(F.lower(F.trim(key_col)).alias("folder")).distinct()
    first = folders.join(k, "folder").groupBy("folder").agg(F.min("order").alias("order"))
    imgs = (children.join(first, ["folder", "order"], "left_semi")
            .where((F.col("type") == "file") & F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
                   & F.col("link").isNotNull()))
    url = F.replace(F.replace("link", F.lit("&export=download"), F.lit("")), F.lit("?usp=drivesdk"), F.lit(""))
    return imgs.select(F.col("folder").alias("key"), "name", url.alias("url"))


# Download link template of a file id.
DOWNLOAD_URL = "https://drive.google.com/uc?id={}&export=download"


def lookup_image_by_path(children: DataFrame, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """File node by full path (first in depth-first order) -> download link; miss -> null."""
    pre, post = DOWNLOAD_URL.split("{}")
    files = (children.where((F.col("type") == "file") & F.col("path").isNotNull())
             .groupBy("path").agg(F.min_by("id", "order").alias("id")))
    j = paths.select(F.col(path_col).alias("path")).join(files, "path", "left")
    return j.select("path", F.when(F.col("id").isNotNull(), F.concat(F.lit(pre), F.col("id"), F.lit(post))).alias("url"))
