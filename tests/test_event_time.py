"""Event-time state, late rows and watermark control on streams: settings that change the result."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from paneflow.operators import joins as J
from paneflow.operators import stateful as S
from paneflow.operators import windows as W
from paneflow.plans import lrb, lrb_streams
from paneflow.plans import stream_sources as SS
from paneflow.plans import streams as ST
from paneflow.plans import watermarks as WM
from paneflow.plans.ysb import ysb_campaign_counts
from paneflow.sources import files as FS
from paneflow.sources import stream_files as SF
from paneflow.sources.tables import load
from paneflow.streaming import processors as P
from paneflow.streaming import runner


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_without_delay_the_out_of_order_stream_loses_rows(spark):
    batch = rows(ysb_campaign_counts(load(spark, SF_SMALL, "events")))
    lossy = rows(ST.out_of_order(spark, SF_SMALL, delay_h=0))
    assert len(lossy) < len(batch) and set(lossy) != set(batch)


def test_late_split_resumes_with_the_same_watermark(spark, tmp_path):
    ev = load(spark, SF_SMALL, "events").select("event_id", "ts")
    whole = [rows(p) for p in WM.late_split(spark, SF_SMALL)]
    assert all(whole) and sorted(whole[0] + whole[1]) == rows(ev)
    # the drops of one run, and the same drops with a rerun of the last epoch in between
    base = f"{tmp_path}/run"
    for part in (ev.where("event_id >= 500"), ev.where("event_id < 500")):
        part.write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            in_time, late = runner.split_late(spark.readStream.schema(ev.schema).parquet(f"{base}/in"), "late", base=base)
    assert {r["event_id"] for r in late.collect()} == set(range(500))
    assert in_time.count() + late.count() == ev.count()


def test_stop_state_holds_one_delay_of_reports(spark):
    """What waits after a drop are the reports of one delay and one jitter, not the vehicles' history."""
    rep = lrb_streams.shifted_reports(spark, SF_SMALL)
    seen = []

    def run(s, base):
        out = runner.run_to_table(P.stop_detector_stream(s.withWatermark("ts", "60 seconds")), "stops", base=base)
        waiting = spark.read.format("statestore").option("path", os.path.join(base, "checkpoint")) \
            .option("stateVarName", "waiting").load()
        seen.append(waiting.count())
        return out

    runner.replay(rep, "stops", run, jitter_us=60_000_000)
    # 50 vehicles report every 30 s
    assert 0 < max(seen) <= 50 * 5 < rep.count() / 3


def test_stops_across_micro_batches(spark):
    """A run that spans drops, an older report that comes a drop later."""
    data = [(1, 0, 0, 0, 10 * k, 0, 500) for k in (1, 2, 4, 5)] + [(2, 0, 0, 0, 10 * k, 0, 700 + k) for k in range(1, 6)]
    late = [(1, 0, 0, 0, 30, 0, 900)]      # breaks the run of vehicle 1
    cols = "vid long, xway long, seg long, speed long, r_time long, lane long, pos long"
    df = spark.createDataFrame(data + late, cols).withColumn("r_time", F.col("r_time") + 86_400).withColumn("ts", F.timestamp_seconds("r_time"))
    base = runner.scratch_path(spark, "drops")
    far = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10**9)))
    for part in (df.where("pos <> 900"), df.where("pos = 900"), far):
        part.write.mode("append").parquet(f"{base}/in")
        out = runner.run_to_table(P.stop_detector_stream(spark.readStream.schema(df.schema).parquet(f"{base}/in").withWatermark("ts", "100 seconds")),
                                  "stops", base=base)
    assert rows(out) == rows(S.stop_events(df).select(*out.columns)) == []
    assert rows(S.stop_events(df.where("pos <> 900")).select("vid")) == [(1,)]


def test_an_epoch_without_its_end_is_not_read(spark):
    ev = load(spark, SF_SMALL, "events").select("event_id", "ts")
    base = runner.scratch_path(spark, "epoch_end")
    begin, length = SS.epoch_bounds(ev)
    first = ev.where(F.unix_micros("ts") < begin + length)
    SF.write_epoch(first, f"{base}/in", "epoch-0", begin + length)
    first.write.parquet(f"{base}/in/epoch-1")             # its rows lie there, its marks do not
    os.remove(f"{base}/in/epoch-1/_SUCCESS")
    s = SF.epoch_stream(spark, f"{base}/in", "event_id long, ts timestamp")
    got = runner.run_to_table(s, "epochs", base=base)
    assert got.where("NOT mark").count() == first.count() and got.where("mark").count() == 1


def test_a_second_write_leaves_no_old_parts(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("ip_pair"), F.col("id").alias("rtt"))
    out = f"{tmp_path}/bin"
    assert FS.write_fixed_width(df.repartition(5), out, FS.PING_LAYOUT) == 100
    assert FS.write_fixed_width(df.limit(10).coalesce(1), out, FS.PING_LAYOUT) == 10
    assert FS.read_fixed_width(spark, out, FS.PING_LAYOUT).count() == 10


@pytest.mark.parametrize("offset", [-50.0, 0.0, 30.0, 500.0])
def test_band_join_is_the_filtered_join(spark, offset):
    ev = load(spark, SF_SMALL, "events").select("event_id", "ts", "value", "event_type")
    ev = ev.unionByName(ev.limit(3).withColumn("value", F.lit(None).cast("double")))
    l_, r_ = (ev.where(F.col("event_type") == k).select("event_id", "ts", "value") for k in ("view", "click"))
    got = J.theta_join_less(l_, r_, "1 day", "1 day", "value", offset, levels=3).select("l_event_id", "r_event_id")
    want = J.theta_join_range(l_, r_, "1 day", "1 day", predicate=lambda a, b: a("value") + F.lit(offset) < b("value")).select("l_event_id", "r_event_id")
    assert rows(got) == rows(want)
    assert W.to_us("1 day") > 0


def test_late_partner_misses_the_join(spark):
    """A click that comes after the watermark has left its view behind finds no partner, and the state is small."""
    ev = load(spark, SF_SMALL, "events")
    kept = {(r["drop_no"], r["side"]): r["rows"] for r in WM.join_state(spark, SF_SMALL).collect()}
    views = ev.where("event_type = 'view'").count()
    assert kept[WM.STATE_DROPS - 1, "left"] < views / 2
