"""Yahoo streaming benchmark queries (Q-YSB1 … Q-YSB5).

Shape of the flagship (Q-YSB3): filter ``view`` → project (ts, ad_id) → join the static
ad→campaign table → per campaign and tumbling window ``count(*)`` and ``max(ts)``.

Scale notes: the filter and projection reach the Parquet scan (``PushedFilters:
StringStartsWith(event_type,view)``, ``ReadSchema`` of two columns); the campaign
table has at most 1 000 rows by construction and is broadcast, so the fact side is
never shuffled for the join; the aggregate is partial per task, then one shuffle
of (window, campaign) partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.functions import predicates as P
from paneflow.operators import aggregate as A
from paneflow.operators import joins as J
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.sources import files as FS
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load
from paneflow.streaming.runner import scratch_path

H = params.HOUR_US


def ysb_views(events: DataFrame) -> DataFrame:
    """FLT-7 / FLT-8: view filter fused with the (ts, ad_id) projection."""
    return X.ad_events(events).filter(P.prefix_equals("event_type", "view")).select("ts", "ad_id")


def ysb_campaign_counts(events: DataFrame, window=params.YSB_WINDOW,
                        campaigns: DataFrame | None = None) -> DataFrame:
    """Q-YSB3: campaign ``count(*)`` and last event time per tumbling window.

    ``campaigns`` is the static dimension (a batch frame); by default it is derived
    from ``events``, which must then be a batch frame too.
    """
    views = ysb_views(events)
    dim = campaigns if campaigns is not None else X.campaigns(events)
    joined = J.stream_static_join(views, dim, "ad_id", dim_bounded=campaigns is None)
    w = W.tumbling(joined, window)
    return A.window_aggregate(w, "window", ["campaign_id"], [
        F.count(F.lit(1)).alias("events"),
        W.micros(F.max("ts")).alias("last_update_us"),
    ])


def ysb_keyed_sum(events: DataFrame, window=params.YSB_WINDOW) -> DataFrame:
    """Q-YSB1 / AGG-8: view filter → key by the record's campaign → sum of the last field."""
    rec = X.ad_events(events).filter(P.prefix_equals("event_type", "view")) \
        .select("ts", F.floor(F.col("ad_id") / 10).cast("long").alias("campaign_id"), "ip")
    w = W.tumbling(rec, window)
    return A.window_aggregate(w, "window", ["campaign_id"], [F.sum("ip").alias("ip_sum")])


def ysb_campaign_count(events: DataFrame, window=params.YSB_WINDOW,
                       campaigns: DataFrame | None = None) -> DataFrame:
    """Q-YSB2 / AGG-10: campaign count per window (``campaigns``: static dimension)."""
    dim = campaigns if campaigns is not None else X.campaigns(events)
    joined = J.stream_static_join(ysb_views(events), dim, "ad_id", dim_bounded=campaigns is None)
    w = W.tumbling(joined, window)
    return A.window_aggregate(w, "window", ["campaign_id"], [F.count(F.lit(1)).alias("events")])


def ysb_count_window(events: DataFrame, n: int = params.COUNT_WINDOW_ROWS) -> DataFrame:
    """Q-YSB4: Q-YSB2 over count-based tumbling windows of ``n`` views."""
    views = X.ad_events(events).filter(P.prefix_equals("event_type", "view")).select("ts", "event_id", "ad_id")
    views = W.count_windows(views, n, ["ts", "event_id"]).select("win_id", "ad_id")
    joined = J.stream_static_join(views, X.campaigns(events), "ad_id", dim_bounded=True)
    return joined.groupBy("win_id", "campaign_id").agg(F.count(F.lit(1)).alias("events"))


def ysb_purchase_lookup(events: DataFrame, window=params.YSB_WINDOW,
                        campaigns: DataFrame | None = None) -> DataFrame:
    """Q-YSB5 / JN-6: purchase events enriched ad → campaign by lookup, count per window
    (``campaigns``: static dimension)."""
    ev = X.ad_events(events).filter(F.col("event_type") == "purchase").select("ts", "ad_id")
    dim = campaigns if campaigns is not None else X.campaigns(events)
    joined = J.stream_static_join(ev, dim, "ad_id", dim_bounded=campaigns is None)
    w = W.tumbling(joined, window)
    return A.window_aggregate(w, "window", ["campaign_id"], [F.count(F.lit(1)).alias("events")])


def ysb_purchase_collect(events: DataFrame, window=params.YSB_WINDOW) -> DataFrame:
    """Q-YSB5 variant / AGG-14: the campaigns of a window collected in arrival order.

    The collected vector stays distributed: one row per element with its position
    (``pos``) inside the window, from a distributed per-window row index.
    """
    ev = X.ad_events(events).filter(F.col("event_type") == "purchase") \
        .select("ts", "event_id", "ad_id")
    joined = J.stream_static_join(ev, X.campaigns(events), "ad_id", dim_bounded=True)
    w = W.tumbling(joined, window).select(*W.bounds("window"), "ts", "event_id", "campaign_id")
    idx = W.row_index(w, ["ts", "event_id"], ["window_start"], out="pos")
    return idx.select("window_start", "window_end", "pos", "campaign_id")


# ---------------------------------------------------------------- registrations

_WIN = f"(epoch_us(ts) // {H}) * {H}"

SQL_YSB3 = with_views(f"""
SELECT {_WIN} AS window_start, {_WIN} + {H} AS window_end, c.campaign_id,
       count(*) AS events, max(epoch_us(e.ts)) AS last_update_us
FROM ad_events e JOIN campaigns c ON e.ad_id = c.ad_id
WHERE starts_with(e.event_type, 'view')
GROUP BY 1, 2, 3""", "ad_events", "campaigns")

SQL_YSB1 = with_views(f"""
SELECT {_WIN} AS window_start, {_WIN} + {H} AS window_end,
       CAST(floor(ad_id / 10) AS BIGINT) AS campaign_id, CAST(sum(ip) AS BIGINT) AS ip_sum
FROM ad_events WHERE starts_with(event_type, 'view')
GROUP BY 1, 2, 3""", "ad_events")

SQL_YSB2 = with_views(f"""
SELECT {_WIN} AS window_start, {_WIN} + {H} AS window_end, c.campaign_id, count(*) AS events
FROM ad_events e JOIN campaigns c ON e.ad_id = c.ad_id
WHERE starts_with(e.event_type, 'view')
GROUP BY 1, 2, 3""", "ad_events", "campaigns")

SQL_YSB4 = with_views(f"""
SELECT win_id, c.campaign_id, count(*) AS events
FROM (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // {params.COUNT_WINDOW_ROWS} AS win_id,
             ad_id FROM ad_events WHERE starts_with(event_type, 'view')) e
JOIN campaigns c ON e.ad_id = c.ad_id
GROUP BY 1, 2""", "ad_events", "campaigns")

SQL_YSB5 = with_views(f"""
SELECT {_WIN} AS window_start, {_WIN} + {H} AS window_end, c.campaign_id, count(*) AS events
FROM ad_events e JOIN campaigns c ON e.ad_id = c.ad_id
WHERE e.event_type = 'purchase'
GROUP BY 1, 2, 3""", "ad_events", "campaigns")

SQL_YSB5_COLLECT = with_views(f"""
SELECT window_start, window_start + {H} AS window_end,
       row_number() OVER (PARTITION BY window_start ORDER BY ts, event_id) - 1 AS pos, campaign_id
FROM (SELECT {_WIN} AS window_start, e.ts, e.event_id, c.campaign_id
      FROM ad_events e JOIN campaigns c ON e.ad_id = c.ad_id
      WHERE e.event_type = 'purchase') x""", "ad_events", "campaigns")


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


@register("q_ysb3", SQL_YSB3)
def q_ysb3(spark, d):
    return ysb_campaign_counts(_ev(spark, d))


@register("q_ysb1", SQL_YSB1)
def q_ysb1(spark, d):
    return ysb_keyed_sum(_ev(spark, d))


@register("q_ysb2", SQL_YSB2)
def q_ysb2(spark, d):
    return ysb_campaign_count(_ev(spark, d))


@register("q_ysb4", SQL_YSB4)
def q_ysb4(spark, d):
    return ysb_count_window(_ev(spark, d))


@register("q_ysb5", SQL_YSB5)
def q_ysb5(spark, d):
    return ysb_purchase_lookup(_ev(spark, d))


@register("q_ysb5_collect", SQL_YSB5_COLLECT)
def q_ysb5_collect(spark, d):
    return ysb_purchase_collect(_ev(spark, d))


@register("jn_6_lookup_enrichment", SQL_YSB5)
def jn_6(spark, d):
    """The lookup against a dimension file."""
    ev, path = _ev(spark, d), scratch_path(spark, "campaigns")
    FS.write_pairs(X.campaigns(ev), path)
    return ysb_purchase_lookup(ev, campaigns=FS.read_pairs(spark, path, "ad_id long, campaign_id long"))


# inventory rows served by these queries
alias("agg_9_campaign_count", "q_ysb3")
alias("jn_5_stream_static_join", "q_ysb3")
alias("flt_7_fused_select_project", "q_ysb3")
alias("agg_8_ysb_keyed_sum", "q_ysb1")
alias("win_10_keyed_window_reduce", "q_ysb1")
alias("agg_10_campaign_count_window", "q_ysb2")
alias("win_4_count_tumbling", "q_ysb4")
alias("agg_14_collect_all", "q_ysb5_collect")
