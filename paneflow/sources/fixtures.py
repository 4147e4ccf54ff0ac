"""Benchmark record streams derived from the test tables (FIXTURES.md §3).

Each function is a pure projection (or, for ``campaigns``, a bounded distinct) of a
base table, written with the DataFrame API so Catalyst prunes columns and pushes
filters into the Parquet scan.  They work on batch and streaming frames alike.

The SQL twins in :mod:`paneflow.plans.sqlviews` are the independent oracle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the derived views (FIXTURES.md §3); they must be equal for right results.
AD_TYPES = ("banner", "modal", "sponsored-search", "mail", "mobile")
AD_ID_MULTIPLIER = 7919
AD_ID_RANGE = 1100          # ad ids 1000..1099 have no campaign
CAMPAIGN_AD_RANGE = 1000    # campaigns exist for ad ids 0..999
ADS_PER_CAMPAIGN = 10
PAGE_RANGE = 100
IP_RANGE = 65536
FEET_PER_SEGMENT = 5280
LRB_VEHICLES = 50


def _floor_div(c: Column, d: int) -> Column:
    return F.floor(c / F.lit(float(d))).cast("long")


def ad_events(events: DataFrame) -> DataFrame:
    """YSB ad events: (event_id, ts, user_id, page_id, ad_id, ad_type, event_type, ip)."""
    eid = F.col("event_id")
    ad_type = F.when(eid % 5 == 0, AD_TYPES[0])
    for i, name in enumerate(AD_TYPES[1:-1], start=1):
        ad_type = ad_type.when(eid % 5 == i, name)
    ad_type = ad_type.otherwise(AD_TYPES[-1])
    return events.select(
        "event_id", "ts", "user_id",
        (eid % PAGE_RANGE).alias("page_id"),
        ((eid * AD_ID_MULTIPLIER) % AD_ID_RANGE).alias("ad_id"),
        ad_type.alias("ad_type"),
        "event_type",
        (eid % IP_RANGE).alias("ip"),
    )


def campaigns(events: DataFrame) -> DataFrame:
    """Static ad → campaign dimension.

    At most ``CAMPAIGN_AD_RANGE`` rows whatever the size of ``events`` (the key is
    ``event_id % 1000``), which is the proven bound that lets joins broadcast it.
    The distinct is a partial (map-side) aggregate, so only ≤1000 rows per map
    task are shuffled.
    """
    ad = (F.col("event_id") % CAMPAIGN_AD_RANGE).alias("ad_id")
    d = events.select(ad).distinct()
    return d.select("ad_id", _floor_div(F.col("ad_id"), ADS_PER_CAMPAIGN).alias("campaign_id"))


def position_reports(events: DataFrame) -> DataFrame:
    """Linear Road position reports (type, time, vid, speed, xway, lane, dir, seg, pos)."""
    eid = F.col("event_id")
    a = events.select("event_id", (eid % LRB_VEHICLES).alias("vid"),
                      _floor_div(eid, LRB_VEHICLES).alias("k"))
    b = a.select(
        "event_id", "vid", "k", _floor_div(F.col("vid"), 10).alias("g"),
        F.when((F.col("vid") % 10).isin(3, 4) & (F.col("k") % 40).between(12, 19), 1)
         .otherwise(0).alias("stopped"))
    stopped = F.col("stopped") == 1
    g, k, vid = F.col("g"), F.col("k"), F.col("vid")
    c = b.select(
        F.when(eid % 97 == 0, 2).otherwise(0).alias("r_type"),
        (F.lit(30) * k + vid % 30).alias("r_time"),
        "vid",
        F.when(stopped, 0).otherwise(20 + (eid * 31) % 60).alias("speed"),
        (g % 2).alias("xway"),
        F.when(stopped, 2).otherwise(eid % 3).alias("lane"),
        F.when(stopped,
               ((g * 20 + _floor_div(k, 40) * 3) * FEET_PER_SEGMENT) % 528000 + 1000)
         .otherwise((g * 20 * FEET_PER_SEGMENT + k * 1320 + vid * 7) % 528000).alias("pos"),
    )
    return c.select("r_type", "r_time", "vid", "speed", "xway", "lane",
                    F.lit(0).alias("dir"),
                    _floor_div(F.col("pos"), FEET_PER_SEGMENT).alias("seg"), "pos")


def trips(lineitem: DataFrame) -> DataFrame:
    """NYT-like taxi trips from ``lineitem``."""
    return lineitem.select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_linenumber").alias("leg"),
        F.col("l_shipdate").alias("pickup_ts"),
        F.when(F.col("l_returnflag") == "R", "CMT").otherwise("VTS").alias("vendor_id"),
        (F.col("l_quantity") / F.lit(4.0)).alias("trip_distance"),
        (F.lit(-74.0) + (F.col("l_partkey") % 1000) / F.lit(10000.0)).alias("pickup_long"),
        (F.lit(40.0) + (F.col("l_suppkey") % 1000) / F.lit(10000.0)).alias("pickup_lat"),
    )


def pings(events: DataFrame) -> DataFrame:
    """Network RTT records (event_id, ts, ip_pair, rtt)."""
    return events.select(
        "event_id", "ts",
        (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("ip_pair"),
        F.floor(F.col("value") * 100).cast("long").alias("rtt"),
    )


def cluster_events(lineitem: DataFrame) -> DataFrame:
    """Google-cluster-like task events from ``lineitem``."""
    return lineitem.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("task_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_linenumber") % 9).alias("event_type"),
        F.col("l_discount").alias("cpu"),
        F.col("l_tax").alias("ram"),
        (F.col("l_quantity") / F.lit(50.0)).alias("disk"),
    )
