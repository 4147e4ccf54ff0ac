"""Streaming: stream = batch on closed windows, sinks, late-data side output."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from paneflow.plans import streams as S
from paneflow.plans.ysb import ysb_campaign_counts
from paneflow.sources.tables import load, load_stream
from paneflow.streaming import runner


def test_stream_equals_batch(spark):
    """The replay ends with a closing row, so every window of the data has closed."""
    streamed = S.stream_campaign_counts(spark, SF_SMALL)
    batch = ysb_campaign_counts(load(spark, SF_SMALL, "events"))
    a = sorted(map(tuple, streamed.collect()))
    assert a == sorted(map(tuple, batch.collect())) and len(a) > 0


def test_noop_console_and_foreach_batch_sinks(spark, capsys):
    ev = load_stream(spark, SF_SMALL, "events").select("event_id", "event_type")
    runner.discard(ev)
    runner.console(ev.filter(F.col("event_id") < 3), num_rows=5)
    out = os.path.join(runner.scratch_path(spark, "fb"), "out")
    runner.run_foreach_batch(ev, "fb", runner.idempotent_parquet_batches(out))
    assert spark.read.parquet(out).count() == load(spark, SF_SMALL, "events").count()


def test_foreach_batch_replay_is_idempotent(spark):
    df = load(spark, SF_SMALL, "events").select("event_id")
    out = os.path.join(runner.scratch_path(spark, "replay"), "out")
    w = runner.idempotent_parquet_batches(out)
    w(df, 7)
    w(df, 7)  # a replayed epoch after a failure
    assert spark.read.parquet(out).count() == df.count()


def test_match_report_sink(spark):
    docs = load(spark, SF_SMALL, "documents").withColumn("ts", F.current_timestamp())
    m = runner.match_report(docs, "text", "the")
    r = m.select("report_latency_s").first()
    assert r is not None and r.report_latency_s >= 0


def test_late_rows_side_output(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(hours=2))], "id long, ts timestamp")
    wm = int((t0 + dt.timedelta(hours=1)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert [r.id for r in runner.late_rows(df, "ts", wm).collect()] == [1]
