"""Streams of several stages and branches: chained aggregates (AGG-21, AGG-25), a graph of queries that
hand their tables on (STR-10), and one source that feeds two branches (SRC-11, STR-11).

A query hands its rows on through its file sink, whose log makes the table a source that is read
exactly once; the graph goes on after a restart as each of its queries does.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import text as T
from paneflow.operators import joins as J
from paneflow.operators import windows as W
from paneflow.plans import lrb, lrb_streams, params
from paneflow.plans import text as TX
from paneflow.plans.registry import ORACLES, register
from paneflow.plans.streams import JOIN_WINDOW, SQL_JOIN, tagged
from paneflow.sources.tables import load
from paneflow.streaming import runner

H, D = params.HOUR_US, params.DAY_US


@register("agg_21_lrb_distinct_vehicles_stream", ORACLES["agg_21_lrb_distinct_vehicles"])
def agg_21_stream(spark, d):
    """Distinct vehicles per segment and minute over jittered drops: each vehicle once per window, then a count."""
    def count(s):
        once = W.tumbling(s, f"{lrb.VEHICLE_WINDOW_S} seconds").select("xway", "seg", "window", "vid") \
                .dropDuplicates(["xway", "seg", "window", "vid"])
        g = once.groupBy("xway", "seg", "window").agg(F.count(F.lit(1)).alias("vehicles"))
        return g.select("xway", "seg", (W.micros("window.end") - lrb_streams.ORIGIN_S * 1_000_000).alias("window_end"), "vehicles")

    return lrb_streams.replayed(spark, d, "vehicles", count)


def user_hours(events: DataFrame) -> DataFrame:
    """Events per user and hour, dated with the last microsecond of the hour."""
    g = events.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.window_time("window").alias("ts"), "user_id", "n")


def active_days(hours: DataFrame) -> DataFrame:
    """The second aggregate, over the rows of the first."""
    g = hours.groupBy(F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("active_user_hours"), F.sum("n").alias("events"), F.max("n").alias("max_per_user_hour"))
    return g.select(*W.bounds("window"), "active_user_hours", "events", "max_per_user_hour")


@register("agg_25_chained_aggregate_stream", ORACLES["agg_25_chained_aggregate"])
def agg_25_stream(spark, d):
    """Both aggregates in one append-mode query."""
    ev = load(spark, d, "events").select("event_id", "user_id", "ts")
    return runner.replay(ev, "days", lambda s, base: runner.run_to_table(
        active_days(user_hours(s.withWatermark("ts", "0 seconds"))), "days", base=base))


def type_hours(events: DataFrame) -> DataFrame:
    """Events per type and hour, dated as :func:`user_hours`."""
    g = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.window_time("window").alias("ts"), "event_type", "n")


def graph(spark, d: str, slices: int = 3) -> DataFrame:
    """STR-10: two queries over the events and two over their tables; one of those reads both.

    The upper two append closed hours.  The lower two run in update mode, so that a day's row is there before the
    next day begins.
    """
    def run(s, base):
        s = s.withWatermark("ts", "0 seconds")
        users = runner.run_to_table(user_hours(s), "users", base=os.path.join(base, "users"))
        types = runner.run_to_table(type_hours(s), "types", base=os.path.join(base, "types"))
        us, ts = (spark.readStream.schema(t.schema).parquet(os.path.join(base, q, "data")).withWatermark("ts", "0 seconds")
                  for q, t in (("users", users), ("types", types)))
        days = runner.run_update(active_days(us), "days", ["window_start", "window_end"], base=os.path.join(base, "days"))
        both = us.select("ts", F.lit("user").alias("of"), "n").unionByName(ts.select("ts", F.lit("type").alias("of"), "n"))
        g = both.groupBy(F.window("ts", "1 day"), "of").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("events"))
        groups = runner.run_update(g.select(*W.bounds("window"), "of", "groups", "events"), "groups",
                                   ["window_start", "window_end", "of"], base=os.path.join(base, "groups"))
        return days.select("window_start", F.lit("days").alias("query"), "active_user_hours", "events") \
                   .unionByName(groups.select("window_start", F.concat(F.lit("groups-"), "of").alias("query"),
                                              F.col("groups").alias("active_user_hours"), "events")) \
                   .withColumnRenamed("active_user_hours", "groups")

    return runner.replay(load(spark, d, "events").select("event_id", "event_type", "user_id", "ts"), "graph", run, slices=slices)


@register("str_10_multi_query_dag", f"""
WITH u AS (SELECT (epoch_us(ts) // {H}) * {H} AS h, user_id, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT (epoch_us(ts) // {H}) * {H} AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT (h // {D}) * {D} AS window_start, 'days' AS query, count(*) AS groups, CAST(sum(n) AS BIGINT) AS events FROM u GROUP BY 1
UNION ALL SELECT (h // {D}) * {D}, 'groups-user', count(*), CAST(sum(n) AS BIGINT) FROM u GROUP BY 1
UNION ALL SELECT (h // {D}) * {D}, 'groups-type', count(*), CAST(sum(n) AS BIGINT) FROM t GROUP BY 1""")
def str_10(spark, d):
    return graph(spark, d)


@register("src_11_fan_out", SQL_JOIN)
def src_11(spark, d):
    """The two inputs of the interval join are branches of one source that is read once."""
    branches = {"view": lambda b: tagged(b, "view", 0), "click": lambda b: tagged(b, "click", 1)}

    def run(s, base):
        out = runner.fan_out(s, "fan_out", branches, base=base)
        return J.interval_join(out["view"], out["click"], ["k"], JOIN_WINDOW, JOIN_WINDOW).select("k", "l_v", "r_v")

    return runner.replay(load(spark, d, "events"), "fan_out", run, close=False)


@register("str_11_two_branches_joined", ORACLES["q_tweet"])
def str_11(spark, d):
    """Word counts and scores of one stream of texts, each a branch over the same epoch, joined on the window end.
    An epoch leaves partial results per window, which are summed before the join."""
    def windowed(b, *cols):
        return W.tumbling(b, TX.WIN).select(W.micros("window.end").alias("window_end"), *cols)

    def words(b):
        w = windowed(b, F.explode(T.find_all("text", T.WORD_PATTERN)).alias("word"))
        return w.groupBy("window_end", F.upper("word").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))

    def scores(b):
        return windowed(b, T.keyword_score_column("text", TX.KEYWORDS).alias("score")) \
            .groupBy("window_end").agg(F.sum("score").alias("score"))

    def run(s, base):
        out = runner.fan_out(s, "branches", {"words": words, "scores": scores}, base=base)
        counts = out["words"].groupBy("window_end", "word").agg(F.sum("cnt").alias("cnt"))
        total = out["scores"].groupBy("window_end").agg(F.sum("score").alias("score"))
        return counts.join(total, "window_end").select("window_end", "word", "cnt", "score")

    return runner.replay(TX.documents(spark, d).select("doc_id", "text", "ts"), "branches", run, close=False)
