"""Watermark control on streams: late rows as a side output (STR-5), the policy of two inputs
(STR-3), and what a join keeps in its state (JN-8)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import register
from paneflow.plans.streams import MAX_LAG_H, lag
from paneflow.sources.tables import load
from paneflow.streaming import runner

H = params.HOUR_US
LATE_DROPS = 6
SPEED_DROPS = 4


# ---------------------------------------------------------------- STR-5 late rows

def late_split(spark, d: str, delay_us: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows of events that arrive up to ``MAX_LAG_H`` hours after their time."""
    ev = load(spark, d, "events").select("event_id", "ts")
    return runner.replay(ev, "late", lambda s, base: runner.split_late(s, "late", delay_us=delay_us, base=base),
                         slices=LATE_DROPS, lag_us=lag(), close=False)


def _sql_late(delay_us: int) -> str:
    return f"""WITH a AS (SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + (event_id * 7919 % {2 * MAX_LAG_H}) * {H // 2} AS arr FROM events),
b AS (SELECT min(arr) AS lo, (max(arr) - min(arr)) // {LATE_DROPS} + 1 AS width FROM a),
k AS (SELECT event_id, t, (arr - lo) // width AS slice FROM a, b),
m AS (SELECT s.slice, (SELECT max(t) FROM k WHERE k.slice < s.slice) AS before FROM (SELECT DISTINCT slice FROM k) s)
SELECT event_id, t AS ts_us, CASE WHEN t < before - {delay_us} THEN 1 ELSE 0 END AS late FROM k JOIN m USING (slice)"""


def _tagged(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    in_time, late = (p.select("event_id", W.micros("ts").alias("ts_us"), F.lit(k).alias("late")) for k, p in enumerate(parts))
    return in_time.unionByName(late)


@register("str_5_late_rows", _sql_late(0))
def str_5(spark, d):
    """Every event with its side; without delay all rows behind an earlier drop are late."""
    return _tagged(late_split(spark, d))


@register("str_5_late_rows_with_delay", _sql_late(24 * H))
def str_5_delay(spark, d):
    """A watermark one day behind moves the younger half of them back in time."""
    return _tagged(late_split(spark, d, 24 * H))


# ---------------------------------------------------------------- STR-3 two inputs of different speed

def two_speeds(spark, d: str, policy: str) -> DataFrame:
    """Events per hour and type over the union of a fast input (views) and a slow one (clicks), which
    comes one drop behind; each has its own watermark, and ``policy`` picks the query's."""
    ev = load(spark, d, "events").select("event_id", "event_type", "ts")
    base = runner.scratch_path(spark, "two_speeds")
    t = F.unix_micros("ts")
    lo, hi = ev.agg(F.min(t), F.max(t)).first()
    lo, hi = lo or 0, hi or 0
    width = (hi - lo) // SPEED_DROPS + 1
    which = F.floor((t - F.lit(lo)) / F.lit(width))
    far = F.timestamp_micros(F.lit(hi + 10 * 365 * params.DAY_US))
    paths = {kind: os.path.join(base, kind) for kind in ("view", "click")}

    def counts() -> DataFrame:
        inputs = [spark.readStream.schema(ev.schema).parquet(p).withWatermark("ts", "0 seconds") for p in paths.values()]
        w = W.tumbling(inputs[0].unionByName(inputs[1]), "1 hour")
        return w.groupBy("window", "event_type").agg(F.count(F.lit(1)).alias("cnt")) \
                .select(W.micros("window.end").alias("window_end"), "event_type", "cnt")

    out = None
    for k in range(SPEED_DROPS + 1):
        for kind, behind in (("view", 0), ("click", 1)):
            rows = ev.where((F.col("event_type") == kind) & (which == k - behind))
            if k == SPEED_DROPS:                      # the closing rows of both inputs
                rows = rows.unionByName(ev.where(F.col("event_type") == kind).limit(1).withColumn("ts", far))
            rows.write.mode("append").parquet(paths[kind])
        out = runner.run_to_table(counts(), "two_speeds", base=base, watermark_policy=policy)
    return out


def _sql_speeds(policy: str) -> str:
    keep = "TRUE" if policy == "min" else "event_type = 'view' OR f.fast IS NULL OR window_end > f.fast"
    return f"""WITH b AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // {SPEED_DROPS} + 1 AS width FROM events),
k AS (SELECT event_type, epoch_us(ts) AS t, (epoch_us(ts) // {H}) * {H} + {H} AS window_end, (epoch_us(ts) - lo) // width AS slice
      FROM events, b WHERE event_type IN ('view', 'click')),
f AS (SELECT s.slice, (SELECT max(t) FROM k WHERE event_type = 'view' AND k.slice <= s.slice) AS fast FROM (SELECT DISTINCT slice FROM k) s)
SELECT window_end, event_type, count(*) AS cnt FROM k JOIN f USING (slice) WHERE {keep} GROUP BY 1, 2"""


@register("str_3_min_watermark", _sql_speeds("min"))
def str_3_min(spark, d):
    """The slower input holds the watermark back: nothing is late."""
    return two_speeds(spark, d, "min")


@register("str_3_max_watermark", _sql_speeds("max"))
def str_3_max(spark, d):
    """The faster input drives the watermark: rows of the slow one miss the windows it has closed."""
    return two_speeds(spark, d, "max")


# ---------------------------------------------------------------- JN-8 state of a join

JOIN_DAYS = 2
STATE_DROPS = 5


def join_state(spark, d: str) -> DataFrame:
    """(drop, side, rows): what views join clicks of one user within ``JOIN_DAYS`` days keeps after each drop."""
    ev = load(spark, d, "events").where(F.col("event_type").isin("view", "click")).select("event_id", "event_type", "user_id", "ts")
    found: list[tuple] = []

    def run(s: DataFrame, base: str) -> None:
        left, right = (s.where(F.col("event_type") == kind).select(
            F.col("user_id").alias(f"{p}k"), F.col("event_id").alias(f"{p}v"), F.col("ts").alias(f"{p}ts")).withWatermark(f"{p}ts", "0 seconds")
            for kind, p in (("view", "l_"), ("click", "r_")))
        span = F.expr(f"INTERVAL {JOIN_DAYS} DAYS")
        j = left.join(right, (F.col("l_k") == F.col("r_k")) & (F.col("r_ts") >= F.col("l_ts") - span) & (F.col("r_ts") <= F.col("l_ts") + span))
        runner.run_to_table(j.select("l_v", "r_v"), "join_state", base=base)
        found.extend((len(found) // 2, side, runner.state_rows(spark, base, side)) for side in ("left", "right"))

    runner.replay(ev, "join_state", run, slices=STATE_DROPS, close=False)
    return spark.createDataFrame(found, "drop_no int, side string, rows long")


SQL_JOIN_STATE = f"""WITH e AS (SELECT event_type, epoch_us(ts) AS t FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT min(t) AS lo, (max(t) - min(t)) // {STATE_DROPS} + 1 AS width FROM e),
k AS (SELECT event_type, t, (t - lo) // width AS slice FROM e, b),
w AS (SELECT d.drop_no, least(max(t) FILTER (event_type = 'view'), max(t) FILTER (event_type = 'click')) // 1000 * 1000 AS wm
      FROM range({STATE_DROPS}) d(drop_no) JOIN k ON k.slice <= d.drop_no GROUP BY 1)
SELECT CAST(drop_no AS INTEGER) AS drop_no, CASE event_type WHEN 'view' THEN 'left' ELSE 'right' END AS side, count(*) AS rows
FROM w JOIN k ON k.slice <= w.drop_no AND k.t > wm - {JOIN_DAYS * params.DAY_US} GROUP BY 1, 2"""


@register("jn_8_join_state_rows", SQL_JOIN_STATE)
def jn_8_state(spark, d):
    """The state follows the join window, not the history: rows the watermark has left behind go."""
    return join_state(spark, d)
