"""Row windows on streams, per key (WIN-3, JN-2): the ordered processors over jittered drops, and the
batch forms they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import ORACLES, register
from paneflow.plans.streams import ROW_WINDOW
from paneflow.sources.tables import load
from paneflow.streaming import processors as P
from paneflow.streaming import runner

SIZE, SLIDE = 50, 20
JITTER_H = 6


def _replayed(df, name, query):
    return runner.replay(df, name, lambda s, base: runner.run_to_table(query(s.withWatermark("ts", f"{JITTER_H} hours")), name, base=base),
                         jitter_us=JITTER_H * params.HOUR_US, conf=runner.STATE_CONF)


@register("win_3_row_windows_per_key", f"""
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
w AS (SELECT *, unnest(range(greatest(0, CAST(floor((i - {SIZE}) / {SLIDE}.0) AS BIGINT) + 1), i // {SLIDE} + 1)) AS win_id FROM r)
SELECT event_type, win_id, count(*) AS cnt, CAST(sum(event_id) AS BIGINT) AS sum_v, min(i) AS first_idx
FROM w WHERE win_id * {SLIDE} + {SIZE} <= n GROUP BY 1, 2""")
def win_3_keyed(spark, d):
    """Full row windows per event type."""
    r = W.row_windows(load(spark, d, "events"), SIZE, SLIDE, ["ts", "event_id"], keys=["event_type"], complete_only=True)
    return r.groupBy("event_type", "win_id").agg(F.count(F.lit(1)).alias("cnt"), F.sum("event_id").alias("sum_v"), F.min("row_idx").alias("first_idx"))


@register("win_3_row_windows_stream", ORACLES["win_3_row_windows_per_key"])
def win_3_stream(spark, d):
    """The same windows from a ring buffer and an arrival counter in state."""
    ev = load(spark, d, "events").select("event_id", "event_type", "ts")
    return _replayed(ev, "row_windows", lambda s: P.row_windows_stream(s, "event_type", "event_id", SIZE, SLIDE))


@register("jn_2_row_window_join_stream", f"""
WITH m AS (
  SELECT user_id, event_id, value, side, row_number() OVER (PARTITION BY user_id ORDER BY ts, side, event_id) - 1 AS mi,
         row_number() OVER (PARTITION BY user_id, side ORDER BY ts, event_id) - 1 AS j
  FROM (SELECT user_id, event_id, ts, value, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS side
        FROM events WHERE event_type IN ('view', 'purchase')) s),
o AS (SELECT *, mi - j AS other, greatest(0, mi - j - {ROW_WINDOW}) AS lo FROM m)
SELECT a.user_id, a.event_id AS l_id, b.event_id AS r_id
FROM o a JOIN o b ON a.user_id = b.user_id AND a.side = 1 AND b.side = 0 AND b.j >= a.lo AND b.j < a.other WHERE a.value < b.value
UNION ALL
SELECT a.user_id, b.event_id, a.event_id
FROM o a JOIN o b ON a.user_id = b.user_id AND a.side = 0 AND b.side = 1 AND b.j >= a.lo AND b.j < a.other WHERE b.value < a.value""")
def jn_2_stream(spark, d):
    """Views and purchases of a user: each meets the last rows of the other side before it."""
    # rows without a user meet nothing; in the operator they would share a pandas column with numbers and turn those to floats
    ev = load(spark, d, "events").where(F.col("event_type").isin("view", "purchase") & F.col("user_id").isNotNull())
    rows = ev.select("user_id", "event_id", "ts", "value", F.when(F.col("event_type") == "view", 1).otherwise(0).alias("side"))
    return _replayed(rows, "row_join", lambda s: P.row_join_stream(s, "user_id", "side", "event_id", "value", ROW_WINDOW))
