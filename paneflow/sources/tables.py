"""Parquet table loader (batch and stream) for the test tables.

``ts`` / ``l_shipdate`` / ``o_orderdate`` are stored as ``timestamp_ntz``;
``withWatermark`` refuses NTZ, so the loader casts every NTZ column to
``timestamp`` (session zone UTC keeps the wall-clock value).  The cast is a
projection on top of the scan, so filters and column pruning still reach the
Parquet reader.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def _fix_ntz(df: DataFrame) -> DataFrame:
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast("timestamp").alias(f.name))
            changed = True
        else:
            cols.append(F.col(f.name))
    return df.select(*cols) if changed else df


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Batch read of one test table with NTZ columns cast to ``timestamp``.

    ``spread=True`` is for tables with heavy per-row work (whole texts): unless the scan has
    a split per ``SPREAD_BYTES`` of the rows (a small file has fewer splits than the cluster has
    cores, one of large row groups has splits without rows), rows are redistributed, so
    tokenising uses every core and a task's share does not grow with the table.
    """
    df = _fix_ntz(spark.read.parquet(table_path(sf_dir, name)))
    return spread_rows(df) if spread else df


#: Bytes of rows that one task of a spread table gets.
SPREAD_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: its strings and eight for each other column."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, t in df.dtypes if t in ("string", "binary")]
    return sum(texts, F.lit(8 * (len(df.columns) - len(texts))).cast("long"))


def spread_rows(df: DataFrame) -> DataFrame:
    """Repartition to a partition per ``SPREAD_BYTES``, the default parallelism at least, if the frame has fewer.

    The bytes are those of the rows: a compressed file says little about them, nor do its splits.  Rows go by a hash of their first two columns (key and text): unlike round robin, that needs no sort of
    the rows in the task that reads them."""
    if df.isStreaming:
        return df
    n_bytes = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_bytes / SPREAD_BYTES))
    return df.repartition(parts, *df.columns[:2]) if df.rdd.getNumPartitions() < parts else df


def load_stream(spark: SparkSession, sf_dir: str, name: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the same table (file source, schema taken from the batch read).

    Each Parquet file is one unit of the file source; ``max_files_per_trigger``
    is the stream form of reading only the first N inputs (SET-2).
    """
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # The file source wants a directory or a glob; one file is matched by a glob
    # whose first letter is a character class.
    return _fix_ntz(r.parquet(os.path.join(sf_dir, f"[{name[0]}]{name[1:]}.parquet")))


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every test table as a temp view (for SQL users)."""
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
