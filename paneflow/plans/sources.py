"""Source rows (SRC-*): each query derives the reference's input format from a test
table with Spark (files written into the shared checkpoint folder), reads it back
with the source under test and returns the decoded records."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import register
from paneflow.plans.sqlviews import with_views
from paneflow.session import cut_lineage
from paneflow.sources import files as FS
from paneflow.sources import fixtures as X
from paneflow.sources.eventtime import assign_event_time
from paneflow.sources.tables import load
from paneflow.streaming import runner

BASE_US = 1_704_067_200_000_000


def _scratch(spark, name: str) -> str:
    return runner.scratch_path(spark, name)


# ---------------------------------------------------------------- SRC-1 CSV

@register("src_1_lrb_csv", with_views("""
SELECT r_type AS type, r_time AS time, vid, speed, xway, lane, dir, seg, pos,
       0 AS qid, 0 AS s_init, 0 AS s_end, 0 AS dow, 0 AS tod, 0 AS day FROM position_reports""",
                                      "position_reports"))
def src_1(spark, d):
    pr = X.position_reports(load(spark, d, "events"))
    cols = [pr.r_type, pr.r_time, pr.vid, pr.speed, pr.xway, pr.lane, pr.dir, pr.seg, pr.pos]
    zeros = [F.lit(0)] * 6
    out = os.path.join(_scratch(spark, "lrb_csv"), "csv")
    pr.select(*[c.cast("int").alias(n) for c, n in zip(cols + zeros, FS.LRB_COLUMNS)]) \
      .write.csv(out)
    r = FS.read_lrb_csv(spark, out)
    return r.select(*[F.col(c).cast("long").alias(c) for c in FS.LRB_COLUMNS])


# ---------------------------------------------------------------- SRC-2 / SRC-3 YSB binary

def ysb_records(events: DataFrame) -> DataFrame:
    """Ad events with the fields of the 78-byte record."""
    ev = X.ad_events(events)
    return ev.select(F.lit(0).alias("user_hi"), F.col("user_id").alias("user_lo"),
                    F.lit(0).alias("page_hi"), F.col("page_id").alias("page_lo"),
                    F.lit(0).alias("campaign_hi"),
                    F.floor(F.col("ad_id") / 10).cast("long").alias("campaign_lo"),
                    "ad_type", "event_type",
                    F.unix_millis("ts").alias("current_ms"), "ip")


def _ysb_binary(spark, d) -> str:
    rec = ysb_records(load(spark, d, "events"))
    out = os.path.join(_scratch(spark, "ysb_bin"), "bin")
    FS.write_fixed_width(rec, out, FS.YSB_LAYOUT, byte_order=">")
    return out


@register("src_2_ysb_fixed_width_binary", with_views("""
SELECT 0 AS user_hi, user_id AS user_lo, 0 AS page_hi, page_id AS page_lo, 0 AS campaign_hi,
       CAST(floor(ad_id / 10) AS BIGINT) AS campaign_lo, substr(ad_type, 1, 9) AS ad_type,
       substr(event_type, 1, 9) AS event_type, epoch_us(ts) // 1000 AS current_ms, ip FROM ad_events""",
                                                     "ad_events"))
def src_2(spark, d):
    return FS.read_fixed_width(spark, _ysb_binary(spark, d), FS.YSB_LAYOUT, ">")


@register("src_3_early_projection", with_views("""
SELECT CAST(floor(ad_id / 10) AS BIGINT) AS campaign_lo, ip FROM ad_events
WHERE starts_with(event_type, 'view')""", "ad_events"))
def src_3(spark, d):
    r = FS.read_fixed_width(spark, _ysb_binary(spark, d), FS.YSB_LAYOUT, ">",
                            fields=["campaign_lo", "event_type", "ip"])
    return r.filter(F.col("event_type").startswith("view")).select("campaign_lo", "ip")


# ---------------------------------------------------------------- SRC-4 NYT binary

@register("src_4_nyt_fixed_width_binary", with_views("""
SELECT vendor_id, epoch_us(pickup_ts) // 1000000 AS pickup_ts, trip_distance, pickup_long, pickup_lat,
       leg AS passenger_count FROM trips""", "trips"))
def src_4(spark, d):
    t = X.trips(load(spark, d, "lineitem"))
    rec = t.select(F.concat(F.lit("M"), F.col("trip_id").cast("string")).alias("medallion"),
                   F.concat(F.lit("H"), F.col("leg").cast("string")).alias("hack_license"),
                   "vendor_id", F.lit(1).alias("rate_code"),
                   F.unix_seconds("pickup_ts").alias("pickup_ts"),
                   (F.unix_seconds("pickup_ts") + 600).alias("dropoff_ts"),
                   F.col("leg").alias("passenger_count"), F.lit(600).alias("trip_time_s"),
                   "trip_distance", "pickup_long", "pickup_lat",
                   F.col("pickup_long").alias("dropoff_long"), F.col("pickup_lat").alias("dropoff_lat"),
                   F.lit(0).alias("store_fwd"))
    out = os.path.join(_scratch(spark, "nyt_bin"), "bin")
    FS.write_fixed_width(rec, out, FS.NYT_LAYOUT, byte_order="<")
    r = FS.read_fixed_width(spark, out, FS.NYT_LAYOUT, "<")
    return r.select("vendor_id", "pickup_ts", "trip_distance", "pickup_long", "pickup_lat",
                    "passenger_count")


# ---------------------------------------------------------------- SRC-7 / SRC-8

@register("src_7_ping_records", with_views(
    "SELECT CAST(ip_pair AS VARCHAR) AS ip_pair, rtt FROM pings", "pings"))
def src_7(spark, d):
    p = X.pings(load(spark, d, "events")).select(F.col("ip_pair").cast("string").alias("ip_pair"), "rtt")
    out = os.path.join(_scratch(spark, "ping_bin"), "bin")
    FS.write_fixed_width(p, out, FS.PING_LAYOUT, byte_order="<")
    return FS.read_fixed_width(spark, out, FS.PING_LAYOUT, "<")


@register("src_8_ad_event_records", with_views("""
SELECT ad_low64, ad_type, event_type, ip FROM (
  SELECT (event_id * 7919) % 1100 AS ad_low64, ad_type, substr(event_type, 1, 8) AS event_type, ip FROM ad_events) x""",
                                               "ad_events"))
def src_8(spark, d):
    ev = X.ad_events(load(spark, d, "events"))
    rec = ev.select(E.uuid_from_long("user_id").alias("user_id"), E.uuid_from_long("page_id").alias("page_id"),
                    E.uuid_from_long("ad_id").alias("ad_id"), "ad_type", "event_type", "ip")
    out = os.path.join(_scratch(spark, "ad_bin"), "bin")
    FS.write_fixed_width(rec, out, FS.AD_EVENT_LAYOUT, byte_order="<")
    r = FS.read_fixed_width(spark, out, FS.AD_EVENT_LAYOUT, "<")
    return r.select(E.uuid_low64("ad_id").alias("ad_low64"), "ad_type", "event_type", "ip")


# ---------------------------------------------------------------- SRC-5 / SRC-6 / SRC-12 / SRC-13 / SRC-14

@register("src_5_text_lines", """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) x
GROUP BY 1""")
def src_5(spark, d):
    out = os.path.join(_scratch(spark, "text"), "txt")
    load(spark, d, "documents").select("text").write.text(out)
    return FS.read_lines(spark, out).groupBy(F.col("value").alias("line")) \
             .agg(F.count(F.lit(1)).alias("n"))


@register("src_6_long_stream", f"""
SELECT (epoch_us(ts) // {params.HOUR_US}) * {params.HOUR_US} AS window_start,
       CAST(sum(event_id) AS BIGINT) AS sum_value, count(*) AS n FROM events GROUP BY 1""")
def src_6(spark, d):
    longs = load(spark, d, "events").select("ts", F.col("event_id").alias("value"))
    w = W.tumbling(longs, "1 hour")
    return w.groupBy(W.micros("window.start").alias("window_start")) \
            .agg(F.sum("value").alias("sum_value"), F.count(F.lit(1)).alias("n"))


@register("src_12_preload", """
SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1""")
def src_12(spark, d):
    with FS.preloaded(load(spark, d, "events").select("event_type", "event_id")) as ev:
        return cut_lineage(ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")))


@register("src_13_file_drop_two_streams", f"""
SELECT l.user_id AS k, l.event_id AS l_v, r.event_id AS r_v
FROM events l JOIN events r ON l.user_id = r.user_id
WHERE l.event_type = 'view' AND r.event_type = 'click'
  AND epoch_us(r.ts) >= epoch_us(l.ts) - {params.HOUR_US} AND epoch_us(r.ts) < epoch_us(l.ts) + {params.HOUR_US}""")
def src_13(spark, d):
    from paneflow.operators import joins as J
    from paneflow.plans.streams import tagged
    base = _scratch(spark, "drop")
    ev = load(spark, d, "events")
    # files arrive in event-time order: one drop per slice of the data's own time range and
    # side; the files of a slice cover its whole time, so the watermark trails by one slice
    slices = 4
    lo, hi = ev.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    lo, hi = (lo, hi) if lo is not None else (BASE_US, BASE_US)
    width = (hi - lo) // slices + 1
    which = F.floor((F.unix_micros("ts") - F.lit(lo)) / F.lit(width))
    for sl in range(slices):
        for kind in ("view", "click"):
            ev.filter((which == sl) & (F.col("event_type") == kind)) \
              .write.mode("append").parquet(os.path.join(base, kind))
    behind = f"{width // 1_000_000 + 7200} seconds"
    schema = ev.schema
    left = tagged(FS.file_drop_stream(spark, os.path.join(base, "view"), schema, 1), "view", 0) \
        .withWatermark("ts", behind)
    right = tagged(FS.file_drop_stream(spark, os.path.join(base, "click"), schema, 1), "click", 1) \
        .withWatermark("ts", behind)
    j = J.interval_join(left, right, ["k"], "1 hour", "1 hour").select("k", "l_v", "r_v")
    return runner.run_to_table(j, "drop_join")


@register("src_14_event_time_assignment", f"""
SELECT doc_id, {BASE_US} + (doc_id // 10) * 1000000 + (doc_id // 100) * 5000000 AS ts_us FROM documents""")
def src_14(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    t = assign_event_time(docs, row="doc_id", bundle=10, delta="1 second", epoch=100, gap="5 seconds")
    return t.select("doc_id", W.micros("ts").alias("ts_us"))
