"""Linear Road as streams (STR-6 to STR-8, UDF-5): event-time state across micro-batches.

The reports arrive in drops and up to ``JITTER_S`` seconds late, so a vehicle's reports come out
of order within and across micro-batches; the watermark trails by the same time.  The processors
buffer a key's rows for that delay and no longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.operators import windows as W
from paneflow.plans import lrb, params
from paneflow.plans.registry import ORACLES, alias, register
from paneflow.sources.tables import load
from paneflow.streaming import processors as P
from paneflow.streaming import runner

JITTER_S = 600
# Spark's first watermark is 1970-01-01 00:00:00 and a row of that instant counts as late: the
# reports' clock starts a day after it (a whole number of all window and period lengths).
ORIGIN_S = 86_400


def shifted_reports(spark, d: str) -> DataFrame:
    """Position reports of all columns as longs, their clock moved to ``ORIGIN_S``."""
    rep = lrb.reports(load(spark, d, "events"))
    longs = [F.col(c).cast("long").alias(c) for c in ("vid", "seg", "speed", "pos", "r_time", "xway")]
    return rep.select(*longs, F.timestamp_seconds(F.col("r_time") + ORIGIN_S).alias("ts"))


def replayed(spark, d: str, name: str, query: Callable[[DataFrame], DataFrame], delay_s: int = JITTER_S,
             slices: int = 3) -> DataFrame:
    """The table that ``query`` over the jittered reports has written after all drops."""
    return runner.replay(shifted_reports(spark, d), name, lambda s, base: runner.run_to_table(
        query(s.withWatermark("ts", f"{delay_s} seconds")), name, base=base), slices=slices, jitter_us=JITTER_S * 1_000_000,
        conf=runner.STATE_CONF)


@register("str_6_stop_detector_stream", lrb.SQL_STOPS)
def str_6_stream(spark, d):
    """Stop events by event-time timers; equal to the batch detector."""
    out = replayed(spark, d, "stops", P.stop_detector_stream)
    return out.withColumn("r_time", F.col("r_time") - ORIGIN_S)


def latest_accidents(changes: DataFrame) -> DataFrame:
    """The accidents of a log of begins (end -1) and ends."""
    keys = ["xway", "pos", "seg", "vid1", "vid2", "start_time"]
    last = changes.groupBy(*keys).agg(F.max("end_time").alias("end_time"))
    return last.withColumns({"start_time": F.col("start_time") - ORIGIN_S,
                             "end_time": F.when(F.col("end_time") < 0, -1).otherwise(F.col("end_time") - ORIGIN_S)})


@register("str_7_accident_stream", lrb.SQL_ACCIDENTS)
def str_7_stream(spark, d):
    """The map of standing vehicles, fed by the stop detector in one query."""
    return latest_accidents(replayed(spark, d, "accidents", P.accident_changes))


@register("str_8_toll_pass_stream", lrb.SQL_TOLL_PASS)
def str_8_stream(spark, d):
    """Periodic passes by re-armed timers: three chained stateful operators in one query."""
    out = replayed(spark, d, "toll_pass", lambda s: P.toll_pass_stream(s, lrb.TOLL_PASS_S))
    return out.withColumn("pass_time", F.col("pass_time") - ORIGIN_S)


def toll_stream(rep: DataFrame, threshold: int = params.LRB_TOLL_THRESHOLD) -> DataFrame:
    """Q-LRB1 / JN-9 / JN-10 as one append-mode query: mean speed per 5 minutes and distinct vehicles per
    minute, joined on the window end; stops in sliding windows of 120 s join them from the outside."""
    end = F.window_time("window")
    speed = W.tumbling(rep, f"{lrb.SPEED_WINDOW_S} seconds").groupBy("xway", "seg", "window").agg(F.avg("speed").alias("avg_speed")) \
             .select(F.col("xway").alias("s_xway"), F.col("seg").alias("s_seg"), end.alias("s_end"), "avg_speed")
    once = W.tumbling(rep, f"{lrb.VEHICLE_WINDOW_S} seconds").select("xway", "seg", "window", "vid").dropDuplicates(["xway", "seg", "window", "vid"])
    vehicles = once.groupBy("xway", "seg", "window").agg(F.count(F.lit(1)).alias("vehicles")).select("xway", "seg", end.alias("end"), "vehicles")
    both = vehicles.join(speed, (F.col("xway") == F.col("s_xway")) & (F.col("seg") == F.col("s_seg")) & (F.col("end") == F.col("s_end")))
    stops = P.stop_changes(rep).where(F.col("kind") == P.STOP).select("xway", "seg", "ts")
    hit = W.sliding(stops, f"{lrb.ACCIDENT_WINDOW_S} seconds", f"{lrb.ACCIDENT_SLIDE_S} seconds").groupBy("xway", "seg", "window") \
           .agg(F.count(F.lit(1)).alias("n_stops")).select(F.col("xway").alias("a_xway"), F.col("seg").alias("a_seg"), end.alias("a_end"), "n_stops")
    cg = both.join(hit, (F.col("xway") == F.col("a_xway")) & (F.col("seg") == F.col("a_seg")) & (F.col("end") == F.col("a_end")), "left")
    acc = F.col("n_stops").isNotNull()
    toll = F.when(acc, 0).otherwise(E.toll("vehicles", "avg_speed", threshold))
    # the time of a window is its last microsecond
    return cg.select((F.unix_micros("end") + 1 - ORIGIN_S * 1_000_000).alias("window_end"), "xway", "seg", "vehicles", "avg_speed",
                     toll.cast("long").alias("toll"), acc.cast("int").alias("accident"))


@register("q_lrb1_stream", ORACLES["q_lrb1"])
def q_lrb1_stream(spark, d):
    """The toll query over jittered drops: seven stateful operators in one query."""
    return replayed(spark, d, "tolls", toll_stream)


alias("udf_5_keyed_state_process_function", "str_6_stop_detector_stream")
