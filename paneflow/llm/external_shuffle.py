"""Two-pass external shuffle into shards (native: DataFrame functions only).

The records are checkpointed first, so that each has a fixed place (its partition and its position
in it).  Pass 1 scatters them uniformly over buckets by a seeded hash of the place; the bucket count
is the input's rows and bytes over those of a bucket, so one bucket fits in a task's memory at any
scale, and neither a hot source nor a record that a third of all rows repeat can fill one.  Pass 2
runs a Fisher-Yates shuffle inside each bucket (Spark's ``shuffle`` of the bucket's array).  The
buckets laid end to end are one random permutation of the table; record *g* of it goes to
shard ``g % shards``, slot ``g // shards``, so shard counts differ by one at most (the law
``rows``) and slots have no gaps.

A retried task gives the same permutation: places do not change, a bucket is a partition of its
own, its array is sorted by place before it is shuffled, and the generator is seeded by the
partition's number.

Defined results: an empty table gives no rows; a null text has no bytes; null and repeated
keys are records like any other, and equal records spread like different ones.  All input columns
are carried; ``bucket``, ``shard``, ``slot`` and ``rank`` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.llm.common import durable, parallelism, text_of

SHARDS = 24
SEED = 20240229
#: What a bucket holds on average at most, whichever is reached first.
BUCKET_ROWS = 50_000
BUCKET_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a record's values take."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def _placed(df: DataFrame, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(the records as ``r`` with their ``place``, their number, the bucket count)."""
    df = durable(df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("bucket", "shard", "slot", "rank")]))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    buckets = max(parallelism(df.sparkSession), -(-n // bucket_rows), -(-size // bucket_bytes))
    return df.select(F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r")), n, buckets


def _ranked(placed: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(r, rank)"""
    scattered = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int"))
    filled = (scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
              .agg(F.array_sort(F.collect_list(F.struct("place", "r")), _by_place).alias("a")))
    shuffled = filled.select("bucket", F.posexplode(F.shuffle("a", seed)).alias("pos", "e"))
    # bucket counts: one row per bucket; their running sum places each bucket
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    # broadcast, or a shuffle join would move the records once more
    return (shuffled.join(F.broadcast(starts), F.col("bucket") == F.col("b"))
            .select("e.r", (F.col("start") + F.col("pos")).cast("long").alias("rank")))


def _by_place(x: Column, y: Column) -> Column:
    """Places are unique, and the records need no order of their own."""
    return F.when(x["place"] < y["place"], -1).otherwise(1)


def permute(df: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns plus ``rank``: the record's place in one random permutation, from 0."""
    placed, _, buckets = _placed(df, bucket_rows, bucket_bytes)
    return _ranked(placed, buckets, seed).select("r.*", "rank")


def _shards(ranked: DataFrame, shards: int) -> DataFrame:
    return ranked.select("r.*", F.pmod(F.col("rank"), F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col("rank") / F.lit(shards)).cast("long").alias("slot"))


def assign(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns plus ``shard`` and ``slot``."""
    placed, _, buckets = _placed(df, bucket_rows, bucket_bytes)
    return _shards(_ranked(placed, buckets, seed), shards)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
                 bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the records, texts included, as ``path/shard=k``.  Each shard is cut into runs of slots of a
    bucket's size; files read in name order, and rows in file order, give the slots in order."""
    placed, n, buckets = _placed(df, bucket_rows, bucket_bytes)
    out, runs = _shards(_ranked(placed, buckets, seed), shards), -(-buckets // shards)
    per_run = max(1, -(-n // (shards * runs)))
    run = F.col("shard") * runs + F.least(F.floor(F.col("slot") / F.lit(per_run)), F.lit(runs - 1))
    (out.repartitionById(shards * runs, run.cast("int")).sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns.  Whole records go through both passes; size and checksum are
    taken from the text where it has arrived."""
    t = text_of()
    return assign(docs).select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"),
                               F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"))
