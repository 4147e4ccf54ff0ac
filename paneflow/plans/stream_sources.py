"""Streaming sources as queries: drops of records and chunks (SRC-2, SRC-5) and punctuated epochs (STR-2)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import ORACLES, register
from paneflow.plans.sources import ysb_records
from paneflow.plans.sqlviews import with_views
from paneflow.sources import files as FS
from paneflow.sources import fixtures as X
from paneflow.sources import stream_files as SF
from paneflow.sources.tables import load
from paneflow.streaming import runner

H = params.HOUR_US
PING_BYTES = 40
CHUNK_BYTES = 100 * PING_BYTES
EPOCHS = 3


def _halves(df: DataFrame, by: str) -> list[DataFrame]:
    return [df.where(F.pmod(F.col(by), F.lit(2)) == k) for k in range(2)]


@register("src_2_binary_record_stream", ORACLES["src_2_ysb_fixed_width_binary"])
def src_2_stream(spark, d):
    """Two drops of binary records; the second run resumes behind the first drop."""
    base = runner.scratch_path(spark, "record_stream")
    rec = ysb_records(load(spark, d, "events"))
    out = None
    for k, part in enumerate(_halves(rec, "current_ms")):
        FS.write_fixed_width(part, f"{base}/in/drop-{k}", FS.YSB_LAYOUT, byte_order=">")
        out = runner.run_to_table(SF.record_stream(spark, f"{base}/in", FS.YSB_LAYOUT, ">"), "records", base=base)
    return out


def ping_chunks(chunks: DataFrame) -> DataFrame:
    """The ping records of chunks that hold whole big-endian records."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("chunk") / PING_BYTES).cast("int") - 1))
    r = chunks.select("chunk", at.alias("i"))
    name = F.expr(f"substring(chunk, i * {PING_BYTES} + 1, 32)")
    rtt = F.conv(F.hex(F.expr(f"substring(chunk, i * {PING_BYTES} + 33, 8)")), 16, 10).cast("long")
    return r.select(F.rtrim(F.decode(name, "ISO-8859-1"), F.lit("\0")).alias("ip_pair"), rtt.alias("rtt"))


def _pings(spark, d) -> DataFrame:
    return X.pings(load(spark, d, "events")).select("event_id", F.col("ip_pair").cast("string").alias("ip_pair"), "rtt")


_SQL_PINGS = with_views("SELECT CAST(ip_pair AS VARCHAR) AS ip_pair, rtt FROM pings", "pings")


@register("src_5_fixed_chunks", _SQL_PINGS)
def src_5_chunks(spark, d):
    """Binary files in chunks of a fixed number of bytes, each chunk split into its records."""
    out = os.path.join(runner.scratch_path(spark, "chunks"), "bin")
    FS.write_fixed_width(_pings(spark, d), out, FS.PING_LAYOUT, byte_order=">")
    return ping_chunks(FS.read_chunks(spark, out, CHUNK_BYTES))


@register("src_5_fixed_chunks_stream", _SQL_PINGS)
def src_5_stream(spark, d):
    """The same chunks from two drops, read as a stream that resumes."""
    base = runner.scratch_path(spark, "chunk_stream")
    out = None
    for k, part in enumerate(_halves(_pings(spark, d), "event_id")):
        FS.write_fixed_width(part, f"{base}/in/drop-{k}", FS.PING_LAYOUT, byte_order=">")
        out = runner.run_to_table(ping_chunks(SF.chunk_stream(spark, f"{base}/in", CHUNK_BYTES)), "chunks", base=base)
    return out


def epoch_bounds(events: DataFrame) -> tuple[int, int]:
    """(begin, length) of the epochs in microseconds: whole days over the time of the events."""
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    lo, hi = (lo or 0) // params.DAY_US, (hi or 0) // params.DAY_US
    return lo * params.DAY_US, ((hi - lo) // EPOCHS + 1) * params.DAY_US


def punctuated_counts(spark, d: str) -> DataFrame:
    """(epoch, window_end, cnt): hourly counts, with the epoch whose end closed the window."""
    ev = load(spark, d, "events").select("event_id", "ts")
    base = runner.scratch_path(spark, "epochs")
    begin, length = epoch_bounds(ev)
    which = F.floor((F.unix_micros("ts") - F.lit(begin)) / F.lit(length))
    w = W.tumbling(SF.epoch_stream(spark, f"{base}/in", "event_id long, ts timestamp").withWatermark("ts", "0 seconds"), "1 hour")
    # the marks count for the watermark only
    counts = w.groupBy("window").agg(F.sum(F.when(F.col("mark"), 0).otherwise(1)).alias("cnt")) \
              .where(F.col("cnt") > 0).select(W.micros("window.end").alias("window_end"), "cnt")
    for k in range(EPOCHS):
        SF.write_epoch(ev.where(which == k), f"{base}/in", f"epoch-{k}", begin + (k + 1) * length)

        def put(df: DataFrame, batch: int, epoch: int = k) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}/batch={batch}")
        runner.run_foreach_batch(counts, "epochs", put, base=base, drain=True)
    return spark.read.schema("window_end long, cnt long, epoch int, batch int").parquet(f"{base}/out").select("epoch", "window_end", "cnt")


_SQL_EPOCHS = f"""WITH b AS (SELECT min(epoch_us(ts)) // {params.DAY_US} AS lo, max(epoch_us(ts)) // {params.DAY_US} AS hi FROM events),
l AS (SELECT lo * {params.DAY_US} AS begin_us, ((hi - lo) // {EPOCHS} + 1) * {params.DAY_US} AS len_us FROM b)
SELECT CAST((epoch_us(ts) - begin_us) // len_us AS INTEGER) AS epoch, (epoch_us(ts) // {H}) * {H} + {H} AS window_end, count(*) AS cnt
FROM events, l GROUP BY 1, 2"""


@register("str_2_punctuation_watermark", _SQL_EPOCHS)
def str_2(spark, d):
    """Every window closes with the end of its epoch, the last one of the epoch too: the rows' own times
    would have kept that one open until rows of the next epoch came."""
    return punctuated_counts(spark, d)
