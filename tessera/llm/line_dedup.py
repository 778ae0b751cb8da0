"""Lines that many documents share are dropped from all of them.

A line's key is the line without blanks at its ends, A-Z in lower case. The distinct keys of each
document are exploded and hashed, the documents of each hash are counted, and keys found in
``min_docs`` documents or more lose all their lines. The lines that go are gathered by document as
positions, and each text is put together again from the runs of lines between them.

Defined cases: every row is a document, also one that repeats another's id or text; a null text is
the empty text, which is one empty line; keys shorter than ``min_chars`` (empty ones, by default)
are never dropped; a text all of whose lines go is the empty text; null ids are documents like any
other; an empty table gives an empty result; other columns of the input stay outside.

Scale: lines cross the cluster as two 64-bit hashes (128 bits: no two of 10^13 lines are expected to
meet), counted map-side first, so a line that a third of all documents hold is one row a task. The
frequent hashes are a written table: where its size allows it Spark broadcasts it, else the lines
meet it in a join whose hot hashes AQE splits (one row on the small side). Only positions of dropped
lines are grouped, by document, and texts cross once, whole, to meet them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text
from tessera.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 10, 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keys_of(text: Column) -> Column:
    """The key of each line, in order."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(BLANKS)))


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """h1, h2, n_docs of the keys that at least ``min_docs`` documents hold."""
    keys = id_and_text(docs, id_col, text_col).select(F.explode(F.array_distinct(keys_of(F.col("text")))).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(*_hashes("key")).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, dropped (positions from 0, ascending), kept_text: a row for each row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    frequent_keys(docs, min_docs, min_chars, id_col, text_col).select("h1", "h2").write.parquet(path)
    frequent = spark.read.parquet(path)
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("tn"), "text")
    lines = texts.select("doc_id", "th", "tn", F.posexplode(keys_of(F.col("text"))).alias("pos", "key")).where(
        F.length("key") >= min_chars).select("doc_id", "th", "tn", "pos", *_hashes("key"))
    gone = lines.join(frequent, ["h1", "h2"]).groupBy(
        F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), F.col("tn").alias("gone_tn")).agg(
        F.sort_array(F.collect_set("pos")).alias("dropped"))  # a set: equal rows of one id share their positions
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")) & (F.col("tn") == F.col("gone_tn"))
    met = texts.join(gone, same, "left").select("doc_id", lines_of(F.col("text")).alias("lines"),
                                                F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    runs = F.expr("transform(sequence(0, size(dropped)), i -> slice(lines, coalesce(get(dropped, i - 1), -1) + 2, "
                  "coalesce(get(dropped, i), size(lines)) - coalesce(get(dropped, i - 1), -1) - 1))")
    return met.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "dropped", F.array_join(F.flatten(runs), "\n").alias("kept_text"))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query ``op12_line_dedup``."""
    return result.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                         F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same keys, counted as texts.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM d),
k AS (SELECT rid, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
j AS (SELECT rid, pos, line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j JOIN d USING (rid) GROUP BY rid, doc_id
"""
