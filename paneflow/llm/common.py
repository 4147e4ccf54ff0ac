"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.session import checkpoint_dir, ship_package

#: White space of the text contracts: blank, tab, line feed, VT, FF, carriage return.
WS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A test table through Spark's own reader (any path scheme Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder of the session."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; read it back."""
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors."""
    ship_package(spark)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: every bucket count grows with it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] numbers), begin[1], ... laid end to end."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


#: Text that a Python task holds at once, unless a single text is longer.
BLOCK_BYTES = 4 << 20


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (or one longer text)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    k = 0
    while k < len(batch):
        n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + limit, "right")) - k)
        yield batch.slice(k, n)
        k += n


def texts_of(column: pa.Array) -> list[str]:
    """A text column as strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]
