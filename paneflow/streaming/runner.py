"""Run Structured Streaming queries to completion (``availableNow``) and sinks (SNK-*).

``run_to_table`` drives a streaming DataFrame through an ``availableNow`` trigger into
a Parquet table under the shared checkpoint folder (``spark.checkpoint.dir``) and
returns the table as a batch DataFrame.  Given a stable folder (``base``) the run is
restartable after executor or driver loss: a rerun resumes from the last committed
offsets and the file sink's log makes the output exactly-once (STR-9).
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.session import checkpoint_dir
from paneflow.sources.tables import row_bytes


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append",
                 trigger: dict | None = None, partition_by: list[str] | None = None,
                 base: str | None = None, watermark_policy: str | None = None) -> DataFrame:
    """Run ``stream`` until all available input is processed; return its output.

    ``base`` is a folder on shared storage that holds the table and its checkpoint: a
    second run with the same folder resumes after the last committed offsets.  Without one
    the run is a single one in a fresh folder.  ``watermark_policy`` ("min" or "max") says which of
    several inputs' watermarks counts in this run (STR-3); a run that resumes keeps its first one.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "checkpoint")
    w = stream.writeStream.format("parquet").outputMode(output_mode) \
        .option("checkpointLocation", ckpt).option("path", out)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with watermarks(spark, watermark_policy):
        q = w.trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(out)


@contextmanager
def watermarks(spark: SparkSession, policy: str | None):
    """The watermark policy of the queries started inside (read once, when a query starts)."""
    key = "spark.sql.streaming.multipleWatermarkPolicy"
    old = spark.conf.get(key)
    if policy:
        spark.conf.set(key, policy)
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: What a state partition gets of a drop, and the most that a drop of a replayed input holds.
STATE_BYTES, DROP_BYTES = 4 << 20, 128 << 20
MIN_STATE_PARTITIONS = 4
# For queries of many or keyed stateful operators.  Every store of every partition commits in each micro-batch: a log of the batch's changes in place of a whole
# snapshot, one store for both sides of a join, and no second look-up per row to count the rows.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """SQL options for the queries started inside; the former values come back at the end."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def state_partitions(spark: SparkSession, n_bytes: int) -> int:
    """State partitions for drops of an input of this size: the session's shuffle partitions at the most."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(MIN_STATE_PARTITIONS, math.ceil(min(n_bytes, DROP_BYTES) / STATE_BYTES)))


def run_foreach_batch(stream: DataFrame, name: str,
                      fn: Callable[[DataFrame, int], None], output_mode: str = "append",
                      base: str | None = None, drain: bool = False) -> None:
    """SNK-4: per-micro-batch callback (``foreachBatch``), run to completion.

    ``fn(batch_df, epoch_id)`` must be idempotent per epoch id for exactly-once output.
    ``base`` as in :func:`run_to_table`.  ``drain`` is for sources that do not know the
    ``availableNow`` trigger (Python data sources: Spark would run one batch and no further one in
    which the watermark closes windows); the query then runs until there is nothing left to do.
    """
    spark = stream.sparkSession
    ckpt = os.path.join(base or scratch_path(spark, name), "checkpoint")
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).foreachBatch(fn)
    if drain:
        q = w.start()
        q.processAllAvailable()
        q.stop()
    else:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception():
        raise q.exception()


def replay(df: DataFrame, name: str, run: Callable[[DataFrame, str], DataFrame | None],
           slices: int = 3, jitter_us: int = 0, ts: str = "ts", lag_us: Column | None = None,
           close: bool = True, conf: dict[str, str] | None = None) -> DataFrame | None:
    """Feed a batch frame to a stream slice by slice and flush it.

    The rows arrive in at least ``slices`` drops in event-time order, more if a drop would hold over
    ``DROP_BYTES``, so a micro-batch and the windows it leaves open stay bounded; with ``jitter_us`` a row
    arrives up to that much later than its time says, with ``lag_us`` as much later as this expression
    says.  ``run(stream, base)`` is called after each drop with the same folder, so every call
    resumes the query.  The last drop (unless ``close`` is off) is a copy of one row, dated ten
    years after all others: it closes every window and stays open itself.  Rows without a time
    never arrive.  ``conf`` holds SQL options of the query, such as :data:`STATE_CONF`.
    """
    spark = df.sparkSession
    base = scratch_path(spark, name)
    drops = os.path.join(base, "in")
    t = F.unix_micros(ts)
    if lag_us is None:
        lag_us = F.pmod(F.xxhash64(*df.columns), F.lit(jitter_us)) if jitter_us else F.lit(0)
    arrival = t + lag_us
    lo, hi, n_bytes = df.agg(F.min(arrival), F.max(arrival), F.sum(row_bytes(df))).first()
    out = None
    if lo is None:
        df.write.parquet(drops)
        return run(spark.readStream.schema(df.schema).parquet(drops), base)
    sized = max(slices, math.ceil(n_bytes / DROP_BYTES))
    width = (hi - lo) // sized + 1
    last = F.timestamp_micros(F.lit(hi + 10 * 365 * 86_400_000_000)).cast(df.schema[ts].dataType)
    # the input is read once and laid out by drop, however many there are
    staged = os.path.join(base, "staged")
    df.where(t.isNotNull()).withColumn("_drop", F.floor((arrival - F.lit(lo)) / F.lit(width))).write.partitionBy("_drop").parquet(staged)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_drop", T.LongType())])).parquet(staged)
    parts = [rows.where(F.col("_drop") == k).drop("_drop") for k in range(sized)]
    closing = [rows.drop("_drop").limit(1).withColumn(ts, last)] if close else []
    conf = {**(conf or {}), "spark.sql.shuffle.partitions": str(state_partitions(spark, n_bytes))}
    for part in [*parts, *closing]:
        part.write.mode("append").parquet(drops)
        with settings(spark, conf):
            out = run(spark.readStream.schema(df.schema).parquet(drops), base)
    return out


def idempotent_parquet_batches(out_dir: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: each epoch overwrites its own ``epoch=<id>`` folder, so
    a replayed epoch after a failure replaces, never duplicates, its rows."""
    def write(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}"))
    return write


def discard(stream: DataFrame, name: str = "noop") -> None:
    """SNK-1: run the query and drop its output (``noop`` sink)."""
    ckpt = os.path.join(scratch_path(stream.sparkSession, name), "checkpoint")
    q = stream.writeStream.format("noop").option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()


def console(stream: DataFrame, name: str = "console", output_mode: str = "append",
            num_rows: int = 20) -> None:
    """SNK-2 / SNK-3: print results per micro-batch (``console`` sink)."""
    ckpt = os.path.join(scratch_path(stream.sparkSession, name), "checkpoint")
    q = stream.writeStream.format("console").outputMode(output_mode) \
        .option("numRows", num_rows).option("truncate", False) \
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def match_report(df: DataFrame, column: str, needle: str, ts: str = "ts") -> DataFrame:
    """SNK-5: rows whose ``column`` contains ``needle``, with the elapsed time between
    the event time and the moment the match is reported (seconds)."""
    return df.filter(F.col(column).contains(needle)).withColumn(
        "report_latency_s",
        (F.unix_micros(F.current_timestamp()) - F.unix_micros(F.col(ts))) / F.lit(1e6))


def late_rows(batch: DataFrame, ts: str, previous_watermark_us: int) -> DataFrame:
    """STR-5 ``late_policy="side"``: rows of a micro-batch older than the previous
    watermark (what append-mode aggregation drops), for a side output."""
    return batch.filter(F.unix_micros(F.col(ts)) < F.lit(previous_watermark_us))


def split_late(stream: DataFrame, name: str, ts: str = "ts", delay_us: int = 0,
               base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """STR-5: run a stateless stream into two tables, rows in time and late rows.

    The watermark of an epoch is the greatest event time of all earlier epochs less ``delay_us``,
    as Spark's own.  Each epoch leaves its greatest time in the run's folder, under its id: a
    resumed run goes on with the same watermark, and an epoch that is run again finds the same earlier
    epochs and writes the same rows to the same places.  Rows without a time are in time.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    seen, schema = os.path.join(base, "latest"), "latest long, epoch long"
    outs = {side: os.path.join(base, side) for side in ("in_time", "late")}
    spark.createDataFrame([], "latest long").write.mode("ignore").parquet(os.path.join(seen, "epoch=-1"))
    for path in outs.values():
        spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(os.path.join(path, "epoch=-1"))

    def write(df: DataFrame, epoch_id: int) -> None:
        df = df.persist()
        t = F.unix_micros(F.col(ts))
        before = spark.read.schema(schema).parquet(seen).where(F.col("epoch") < epoch_id).agg(F.max("latest")).first()[0]
        late = late_rows(df, ts, before - delay_us) if before is not None else df.limit(0)
        in_time = df.where(t.isNull() | (t >= before - delay_us)) if before is not None else df
        for path, rows in ((outs["late"], late), (outs["in_time"], in_time)):
            rows.write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch_id}"))
        df.agg(F.max(t).alias("latest")).write.mode("overwrite").parquet(os.path.join(seen, f"epoch={epoch_id}"))
        df.unpersist()

    run_foreach_batch(stream, name, write, base=base)
    read = spark.read.schema(stream.schema)
    in_time, late = (read.parquet(outs[side]).select(*stream.columns) for side in ("in_time", "late"))
    return in_time, late


def state_rows(spark: SparkSession, base: str, side: str | None = None, operator: int = 0) -> int:
    """Rows that a stateful operator of the run in ``base`` holds after its last micro-batch, from
    Spark's state data source; ``side`` names a join's input ("left" or "right")."""
    r = spark.read.format("statestore").option("path", os.path.join(base, "checkpoint")).option("operatorId", operator)
    return (r.option("joinSide", side) if side else r).load().count()


def fan_out(stream: DataFrame, name: str, branches: dict[str, Callable[[DataFrame], DataFrame]],
            base: str | None = None) -> dict[str, DataFrame]:
    """SRC-11 / STR-11: one source feeding several branches.

    Each epoch is read once, kept, and handed to every branch, a function of the epoch's rows; a branch
    has a table of its own with a folder per epoch, so an epoch that is run again replaces its rows in
    all of them.  A branch that aggregates leaves one partial result per epoch.  ``base`` as in
    :func:`run_to_table`.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    outs = {b: os.path.join(base, f"branch-{b}") for b in branches}
    schemas = {b: fn(spark.createDataFrame([], stream.schema)).schema for b, fn in branches.items()}
    for b, path in outs.items():
        spark.createDataFrame([], schemas[b]).write.mode("ignore").parquet(os.path.join(path, "epoch=-1"))

    def write(df: DataFrame, epoch_id: int) -> None:
        df = df.persist()
        try:
            for b, fn in branches.items():
                fn(df).write.mode("overwrite").parquet(os.path.join(outs[b], f"epoch={epoch_id}"))
        finally:
            df.unpersist()

    run_foreach_batch(stream, name, write, base=base)
    return {b: spark.read.schema(schemas[b]).parquet(path).select(*schemas[b].names) for b, path in outs.items()}


def run_complete(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """STR-12: run an aggregate in ``complete`` mode; every epoch's output replaces the
    previous snapshot folder (idempotent), and the final snapshot is returned, windows that
    are still open included.  ``base`` as in :func:`run_to_table`."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    out = os.path.join(base, "snapshot")

    def write(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(out)

    run_foreach_batch(stream, name, write, output_mode="complete", base=base)
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, name: str, keys: list[str], base: str | None = None) -> DataFrame:
    """STR-12: run an aggregate in ``update`` mode.  An epoch holds only the rows that
    changed, so each epoch keeps a folder of its own and a key's row is the one of its
    latest epoch.  ``base`` as in :func:`run_to_table`."""
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    out = os.path.join(base, "epochs")
    run_foreach_batch(stream, name, idempotent_parquet_batches(out), output_mode="update", base=base)
    rows = spark.read.schema(stream.schema.add("epoch", "long")).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
    return last.select(*keys, "r.*").select(*stream.columns)
