"""A prepared index of an image tree: written once for each state of the tree, read by key.

``files`` holds the flattened images, partitioned by a hash of their key and sorted by it, so that one
key reads one partition; ``keys`` and ``aliases`` are the exact look-ups; ``grams`` and ``frequency``
serve the containment search, which runs for those queries only that nothing else resolves. A tree
that has changed has another fingerprint and so another index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.prepared import prepared
from .images import alias_index, read_state_nodes, scan_image_tree

VERSION = "1"  # bump when the tables change, so that stored indexes are written anew
#: Partitions of the files by key.
KEY_PARTITIONS = 64


def _partition_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_PARTITIONS)).cast("int")


@dataclass(frozen=True)
class ImageIndex:
    """The tables of a prepared index."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def images(self) -> DataFrame:
        """The flattened images, as ``scan_image_tree`` gives them."""
        return self._read("files").drop("part")

    def images_of(self, key: str) -> DataFrame:
        """The images of exactly this key: one partition is read."""
        k = F.lit(key)
        return self._read("files").where((F.col("part") == _partition_of(k)) & (F.col("key") == k)).drop("part")

    def keys(self) -> DataFrame:
        return self._read("keys")

    def aliases(self) -> DataFrame:
        return self._read("aliases")

    def grams(self) -> DataFrame:
        return self._read("grams")

    def frequency(self) -> DataFrame:
        return self._read("frequency")


def _grams(s: Column, n: int) -> Column:
    """All substrings of length n (at least one element)."""
    ln = F.length(s)
    return F.transform(F.sequence(F.lit(1), F.greatest(ln - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))


GRAM = 3


def _all_grams(df: DataFrame, col: str) -> DataFrame:
    """Distinct grams of lengths 1..GRAM of ``col``, one row each (g, gl)."""
    arrs = [F.transform(_grams(F.col(col), L), lambda g: F.struct(g.alias("g"), F.length(g).alias("gl")))
            for L in range(1, GRAM + 1)]
    return df.select("*", F.explode(F.array_distinct(F.flatten(F.array(*arrs)))).alias("x")).select(
        *df.columns, "x.*").where(F.col("gl") > 0)


def _gram_freq(grams: DataFrame, owner: str) -> DataFrame:
    """How many strings contain each gram, from the distinct grams of each; at most (alphabet size)^GRAM rows."""
    return grams.groupBy("g", "gl").agg(F.count(owner).alias("df"))


def _rarest_probe(df: DataFrame, col: str, freq: DataFrame) -> DataFrame:
    """For each string: its rarest gram of length min(len, GRAM) by ``freq`` (a gram absent
    from ``freq`` has frequency 0, so the string then matches nothing). Every gram of a
    contained string occurs in the containing one, so this single probe finds all partners."""
    gl = F.least(F.length(col), F.lit(GRAM))
    own = df.select("*", F.explode(F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(col) - gl + 1), lambda i: F.substring(col, i, GRAM)))).alias("g"))
    own = own.select("*", F.length("g").alias("gl")).where(F.col("gl") == gl)
    j = own.join(freq, ["g", "gl"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    keep = [c for c in df.columns]
    best = j.groupBy(*keep).agg(F.min_by(F.struct("g", "gl"), F.struct("df", "g")).alias("p"))
    return best.select(*keep, "p.g", "p.gl")


def write_lookup(images: DataFrame, path: str) -> ImageIndex:
    """The look-up tables of ``images`` (key, alias, folder_order); ``frequency`` comes last and tells that
    they are whole."""
    index = ImageIndex(images.sparkSession, path)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    put(images.select("key").distinct(), "keys")
    put(alias_index(images), "aliases")
    # grams are dealt by value, those of a frequent one cut by measured size: no pass for a sample makes them twice
    put(_all_grams(index.keys(), "key").hint("rebalance", F.col("g")).sortWithinPartitions("g", "key"), "grams")
    put(_gram_freq(index.grams(), "key"), "frequency")
    return index


def write_index(images: DataFrame, path: str) -> ImageIndex:
    """Write the files by key, then the look-up tables from them. The files are dealt by part and those of a
    large part cut by their measured size, without a pass for a sample of them."""
    (images.withColumn("part", _partition_of(F.col("key"))).hint("rebalance", F.col("part"))
     .sortWithinPartitions("part", "key", "file_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/files"))
    return write_lookup(ImageIndex(images.sparkSession, path).images(), path)


def image_index(spark: SparkSession, tree_path: str, whole_document: bool = False) -> ImageIndex:
    """The index of a tree as it now is: found by the fingerprint of its files, or written."""
    def build(folder: str) -> None:
        write_index(scan_image_tree(read_state_nodes(spark, tree_path, whole_document)), folder)

    return ImageIndex(spark, prepared(spark, "imgindex", [tree_path], VERSION, "frequency", build))


def _contained(rest: DataFrame, index: ImageIndex) -> DataFrame:
    """query, key, method of the closest key in length that holds the query or is held by it (ties by key).

    A query inside a key: the key has all grams of the query, so the rarest one finds every partner. A
    key inside a query is one of the query's parts of the lengths that keys have."""
    holding = _rarest_probe(rest, "qn", index.frequency()).join(index.grams(), ["g", "gl"]).where(
        F.col("key").contains(F.col("qn"))).select("query", "qn", "key")
    lengths = index.keys().agg(F.array_sort(F.collect_set(F.length("key")))).scalar()  # a few lengths
    sized = rest.select("query", "qn", F.explode(F.sequence(F.lit(1), F.length("qn"))).alias("n")).where(F.array_contains(lengths, F.col("n")))
    parts = sized.select("query", "qn", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("qn") - F.col("n") + 1), lambda i: F.substring(F.col("qn"), i, F.col("n"))))).alias("key"))
    held = parts.join(index.keys(), "key").select("query", "qn", "key")
    score = F.struct(F.abs(F.length("key") - F.length("qn")).alias("score"), "key")
    return holding.unionByName(held).groupBy("query").agg(F.min(score).alias("best")).select(
        "query", F.col("best.key").alias("key"), F.lit("partial").alias("method"))


def lookup(queries: DataFrame, index: ImageIndex, q_col: str = "query") -> DataFrame:
    """query, key, method per row of ``queries``: exact key, else alias, else containment either way with
    the smallest length difference (ties by key); unresolved ones have a null key. Equal queries are
    resolved once, and only those left over after keys and aliases meet the grams."""
    asked = queries.select(F.col(q_col).alias("query"))
    q = asked.distinct().withColumn("qn", F.lower(F.trim("query")))
    named = q.join(index.keys().withColumn("is_key", F.lit(True)).withColumnRenamed("key", "qn"), "qn", "left").join(
        index.aliases().select(F.col("alias").alias("qn"), F.col("key").alias("alias_key")), "qn", "left")
    seen = reliable_checkpoint(named.select(
        "query", "qn", F.when(F.col("is_key"), F.col("qn")).otherwise(F.col("alias_key")).alias("key"),
        F.when(F.col("is_key"), F.lit("exact")).when(F.col("alias_key").isNotNull(), F.lit("alias")).alias("method")))
    found = seen.where("method IS NOT NULL").drop("qn")
    rest = seen.where((F.col("method").isNull()) & (F.length("qn") > 0)).select("query", "qn")
    return asked.join(found.unionByName(_contained(rest, index)), "query", "left")


def images_of_key(index: ImageIndex, key: str) -> DataFrame:
    """The images of one key: of the equal key, else of its alias, else by containment."""
    k = key.strip().lower()
    exact = index.images_of(k)
    if not exact.isEmpty():
        return exact
    row = lookup(index.spark.createDataFrame([(key,)], "query string"), index).first()
    return index.images_of(row["key"]) if row["key"] is not None else exact.limit(0)
