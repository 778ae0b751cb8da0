"""Delimited text sources: every column read as string, separator by extension.

A folder may hold files of different writers. Each file's encoding, whether its records span lines,
and its header are found in one pass over the raw lines, grouped by file; files that agree are read
together, and the parts are united by column name.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings of raw files, in the order they are tried (latin-1, under its standard name, accepts any byte).
ENCODINGS = ("utf-8", "iso-8859-1")
_MARK = "﻿"


def describe_files(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, spans (some line has an odd number of quotes, so a record goes on in the next),
    header (its bytes): a row per file, from an aggregate that reduces map-side."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("v"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).alias("place"))
    quotes = F.length("v") - F.length(F.replace(F.col("v").cast("string"), F.lit('"'), F.lit("")).cast("binary"))
    return lines.groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8(F.col("v").cast("string"))), F.lit(ENCODINGS[0])).otherwise(F.lit(ENCODINGS[1])).alias("encoding"),
        F.bool_or(quotes % 2 == 1).alias("spans"), F.hex(F.min_by("v", "place")).alias("header"))


def scan_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV/TSV/TXT with a header; no schema inference (all strings). ``.tsv`` implies tab.

    Without an ``encoding`` each file has the first of ENCODINGS in which all its lines decode. Quoted
    fields may hold separators, doubled quotes and line breaks; only files with a line break in quotes
    are read whole by one task, others are split. Files whose headers differ are united by name, a
    column that a file lacks is null. A byte order mark is no part of the first name."""
    if sep is None:
        sep = "\t" if path.rstrip("/").lower().endswith(".tsv") else ","
    groups: dict[tuple, list[str]] = {}
    for r in describe_files(spark, path).orderBy("file").collect():  # a row per file
        groups.setdefault((encoding or r["encoding"], r["spans"], r["header"]), []).append(unquote(r["file"]))

    def read(enc: str, spans: bool, files: list[str] | str) -> DataFrame:
        df = (spark.read.option("header", True).option("sep", sep).option("encoding", enc).option("quote", '"').option("escape", '"')
              .option("inferSchema", False).option("multiLine", spans).csv(files))
        return df.toDF(*[c.removeprefix(_MARK) for c in df.columns])

    if len(groups) <= 1:
        enc, spans, _ = next(iter(groups), (encoding or ENCODINGS[0], False, ""))
        return read(enc, spans, path)
    parts = [read(enc, spans, files) for (enc, spans, _), files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
