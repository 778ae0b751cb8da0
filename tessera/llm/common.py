"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

#: Text handled at a time inside a task: as words it takes some 15 times as much memory.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty text; other columns stay outside."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        col = b.column(b.schema.get_field_index(text_col))
        lens = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(lens) // limit)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    return reliable_checkpoint(df)
