"""Single-operator inventory rows (projection, filters, aggregates, windows, sets,
scalar functions, UDF surface), each a small query over the test tables with its
DuckDB twin.  Window sizes are test-scale (1 h over ``events``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.functions import predicates as P
from paneflow.operators import aggregate as A
from paneflow.operators import joins as J
from paneflow.operators import project as PR
from paneflow.operators import windows as W
from paneflow.plans import lrb, params
from paneflow.plans.registry import ORACLES, alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load
from paneflow.streaming import runner

H = params.HOUR_US
D = params.DAY_US
SLIDE = 30 * 60 * 1_000_000
SIZE = 2 * H
STREAM_START_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


def _ev(spark, d) -> DataFrame:
    return load(spark, d, "events")


def _v100(df: DataFrame) -> DataFrame:
    """Integer measure used by exact aggregate checks: floor(value * 100)."""
    return df.withColumn("v100", F.floor(F.col("value") * 100).cast("long"))


def ws(size_us: int = H, off: int = 0, col: str = "ts") -> str:
    return f"((epoch_us({col}) - {off}) // {size_us}) * {size_us} + {off}"


V100 = "CAST(floor(value * 100) AS BIGINT)"

# ---------------------------------------------------------------- projections


@register("prj_1_projection", "SELECT event_id, value * 2.0 AS v2, user_id + 1 AS u1 FROM events")
def prj_1(spark, d):
    return PR.project(_ev(spark, d), "event_id", (F.col("value") * 2.0).alias("v2"),
                      (F.col("user_id") + 1).alias("u1"))


@register("prj_3_pass_through",
          "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events")
def prj_3(spark, d):
    p = PR.pass_through(_ev(spark, d))
    return p.withColumn("ts_us", W.micros("ts")).drop("ts")


@register("prj_5_key_one_pairs", with_views(
    "SELECT page_id, count(*) AS cnt FROM (SELECT page_id, 1 AS one FROM ad_events) x GROUP BY 1",
    "ad_events"))
def prj_5(spark, d):
    kv = X.ad_events(_ev(spark, d)).select("page_id", F.lit(1).alias("one"))
    return kv.groupBy("page_id").agg(F.count("one").alias("cnt"))


@register("prj_6_pardo_plus_one", "SELECT event_id, user_id + 1 AS plus_one FROM events")
def prj_6(spark, d):
    def plus_one(pdf):
        return pdf.assign(plus_one=pdf["user_id"] + 1)[["event_id", "plus_one"]]
    return PR.par_do(_ev(spark, d).select("event_id", "user_id"), plus_one,
                     "event_id long, plus_one long")


@register("prj_7_update_with_drop",
          "SELECT user_id, value * 10.0 AS value FROM events WHERE value * 10.0 >= 100.0")
def prj_7(spark, d):
    two = _ev(spark, d).select("user_id", "value")          # SRC-10 two-column source
    return PR.update_columns(two, {"value": F.col("value") * 10.0}, F.col("value") >= 100.0)


alias("src_10_two_column_source", "prj_7_update_with_drop")

# ---------------------------------------------------------------- filters


@register("flt_1_selection", "SELECT event_id, value FROM events WHERE value > 25.0")
def flt_1(spark, d):
    return _ev(spark, d).filter(F.col("value") > 25.0).select("event_id", "value")


_FLT2 = ("user_id != 7 AND event_id >= 10 AND value < 40.0 AND value > 1.0 AND user_id <= 140 "
         "AND event_id % 2 = 0")


@register("flt_2_comparisons", f"SELECT event_id FROM events WHERE {_FLT2}")
def flt_2(spark, d):
    pred = P.all_of(P.compare_value("user_id", "!=", 7), P.compare_value("event_id", ">=", 10),
                    P.compare_value("value", "<", 40.0), P.compare_value("value", ">", 1.0),
                    P.compare_value("user_id", "<=", 140),
                    P.compare(F.col("event_id") % 2, "=", F.lit(0)))
    return _ev(spark, d).filter(pred).select("event_id")


@register("flt_3_wide_key_compare",
          "SELECT event_id FROM events WHERE user_id > 70 OR (user_id = 70 AND event_id >= 5000)")
def flt_3(spark, d):
    return _ev(spark, d).filter(P.compare_wide("user_id", "event_id", ">=", F.lit(70), F.lit(5000))) \
                        .select("event_id")


@register("flt_4_and_or",
          "SELECT event_id FROM events WHERE (event_type = 'view' AND value > 30.0) OR "
          "(event_type = 'click' AND value < 5.0) OR user_id = 3")
def flt_4(spark, d):
    e = F.col("event_type")
    pred = P.any_of(P.all_of(e == "view", F.col("value") > 30.0),
                    P.all_of(e == "click", F.col("value") < 5.0), F.col("user_id") == 3)
    return _ev(spark, d).filter(pred).select("event_id")


@register("flt_5_selectivity_parameters",
          "SELECT event_id FROM events WHERE value >= 10.0 AND value >= 9.0 AND value >= 8.0 "
          "AND value < 30.0")
def flt_5(spark, d):
    pred = P.conjunction("value", 3, 10.0) & P.selectivity_filter("value", 0.5, 0.0, 60.0)
    return _ev(spark, d).filter(pred).select("event_id")


@register("flt_8_view_prefix_filter", with_views(
    "SELECT event_id, ad_id FROM ad_events WHERE starts_with(event_type, 'view')", "ad_events"))
def flt_8(spark, d):
    return X.ad_events(_ev(spark, d)).filter(P.prefix_equals("event_type", "view")) \
            .select("event_id", "ad_id")


@register("flt_11_threshold_select", with_views(
    "SELECT event_id, rtt FROM pings WHERE rtt >= 2000", "pings"))
def flt_11(spark, d):
    return X.pings(_ev(spark, d)).filter(F.col("rtt") >= 2000).select("event_id", "rtt")


@register("udf_8_text_predicate",
          "SELECT event_id FROM events WHERE value > 20 AND event_type = 'click'")
def udf_8(spark, d):
    return _ev(spark, d).filter(P.from_text("value > 20 AND event_type = 'click'")).select("event_id")


alias("flt_3_predicates_128bit", "flt_3_wide_key_compare")
alias("udf_1_filter_map_key_functions", "flt_4_and_or")

# ---------------------------------------------------------------- aggregates

_PINGS = with_views("SELECT * FROM pings", "pings")


@register("agg_1_aggregation_parser", with_views(f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, count(*) AS cnt, avg(rtt) AS avg_rtt,
       min(rtt) AS min_rtt, max(rtt) AS max_rtt, CAST(sum(rtt) AS BIGINT) AS sum_rtt
FROM pings GROUP BY 1, 2""", "pings"))
def agg_1(spark, d):
    w = W.tumbling(X.pings(_ev(spark, d)), "1 hour")
    return A.window_aggregate(w, "window", [], A.parse_aggs("cnt,avg,min,max,sum", "rtt"))


@register("agg_2_ungrouped_window_aggregate", with_views(f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, min(epoch_us(ts)) AS first_ts_us,
       CAST(sum(rtt) AS BIGINT) AS sum_rtt, count(*) AS cnt
FROM pings GROUP BY 1, 2""", "pings"))
def agg_2(spark, d):
    w = W.tumbling(X.pings(_ev(spark, d)), "1 hour")
    return A.window_aggregate(w, "window", [], [W.micros(F.min("ts")).alias("first_ts_us"),
                                                 F.sum("rtt").alias("sum_rtt"),
                                                 F.count(F.lit(1)).alias("cnt")])


@register("agg_3_multiple_aggregates", f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, event_type, count(*) AS cnt,
       CAST(sum({V100}) AS BIGINT) AS sum_v, min({V100}) AS min_v, max({V100}) AS max_v,
       avg({V100}) AS avg_v, count(DISTINCT user_id) AS users
FROM events GROUP BY 1, 2, 3""")
def agg_3(spark, d):
    w = W.tumbling(_v100(_ev(spark, d)), "1 hour")
    return A.window_aggregate(w, "window", ["event_type"], [
        F.count(F.lit(1)).alias("cnt"), F.sum("v100").alias("sum_v"), F.min("v100").alias("min_v"),
        F.max("v100").alias("max_v"), F.avg("v100").alias("avg_v"),
        F.countDistinct("user_id").alias("users")])


alias("agg_6_partial_final_merge", "agg_3_multiple_aggregates")


def _sliding_sql(value_aggs: str, keys: str = "event_type") -> str:
    k = SIZE // SLIDE
    return f"""
SELECT window_start, window_start + {SIZE} AS window_end, {keys}, {value_aggs}
FROM (SELECT (epoch_us(ts) // {SLIDE}) * {SLIDE} - s.i * {SLIDE} AS window_start, {keys}, {V100} AS v100
      FROM events, (SELECT unnest(range({k})) AS i) s) x
GROUP BY 1, 2, 3"""


_SLIDE_AGGS = ("count(*) AS cnt, CAST(sum(v100) AS BIGINT) AS sum_v, min(v100) AS min_v, "
               "max(v100) AS max_v, CAST(sum(v100) AS DOUBLE) / count(*) AS avg_v")


@register("agg_5_pane_sliding_aggregate", _sliding_sql(_SLIDE_AGGS))
def agg_5(spark, d):
    return A.pane_sliding(_v100(_ev(spark, d)), "2 hours", "30 minutes", {
        "cnt": ("cnt", None), "sum_v": ("sum", "v100"), "min_v": ("min", "v100"),
        "max_v": ("max", "v100"), "avg_v": ("avg", "v100")}, keys=["event_type"])


alias("win_6_superwindow_panes", "agg_5_pane_sliding_aggregate")


@register("agg_5_pane_sliding_stream", _sliding_sql(_SLIDE_AGGS))
def agg_5_stream(spark, d):
    """The pane rewrite as an append-mode stream."""
    return runner.replay(_ev(spark, d), "panes", lambda s, base: runner.run_to_table(
        A.pane_sliding(_v100(s.withWatermark("ts", "0 seconds")), "2 hours", "30 minutes", {
            "cnt": ("cnt", None), "sum_v": ("sum", "v100"), "min_v": ("min", "v100"),
            "max_v": ("max", "v100"), "avg_v": ("avg", "v100")}, keys=["event_type"]), "panes", base=base))


@register("win_2_sliding_drop_leading", f"""
SELECT * FROM ({_sliding_sql("count(*) AS cnt, CAST(sum(v100) AS BIGINT) AS sum_v")}) y
WHERE window_start >= {STREAM_START_US}""")
def win_2(spark, d):
    w = W.sliding(_v100(_ev(spark, d)), "2 hours", "30 minutes", stream_start="2024-01-01 00:00:00")
    return A.window_aggregate(w, "window", ["event_type"], [F.count(F.lit(1)).alias("cnt"),
                                                             F.sum("v100").alias("sum_v")])


@register("win_13_custom_window_assigner", _sliding_sql("count(*) AS cnt"))
def win_13(spark, d):
    w = W.custom(_ev(spark, d), W.every_n_windows("2 hours", "30 minutes"))
    return A.window_aggregate(w, "window", ["event_type"], [F.count(F.lit(1)).alias("cnt")])


@register("agg_15_window_sum_longs", with_views(f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, CAST(sum(rtt) AS BIGINT) AS sum_rtt
FROM pings GROUP BY 1, 2""", "pings"))
def agg_15(spark, d):
    w = W.tumbling(X.pings(_ev(spark, d)), "1 hour")
    return A.window_aggregate(w, "window", [], [F.sum("rtt").alias("sum_rtt")])


alias("win_1_tumbling_event_time", "agg_15_window_sum_longs")


@register("agg_22_latency_quantiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rk,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT event_type, count(*) AS n, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1),
t AS (SELECT s.*, p, p * (n + 1) / 100.0 AS pos FROM s, (VALUES (5.0), (25.0), (50.0), (75.0), (99.0)) ps(p)),
u AS (SELECT *, CASE WHEN pos < 1 THEN 0 WHEN pos >= n THEN n - 1 ELSE CAST(floor(pos) AS BIGINT) - 1 END AS lo,
                CASE WHEN pos < 1 THEN 0 WHEN pos >= n THEN n - 1 ELSE CAST(floor(pos) AS BIGINT) END AS hi,
                CASE WHEN pos < 1 OR pos >= n THEN 0.0 ELSE pos - floor(pos) END AS dif FROM t)
SELECT u.event_type, u.p, a.value + u.dif * (b.value - a.value) AS quantile, u.n, u.mn AS min, u.mx AS max
FROM u JOIN r a ON a.event_type = u.event_type AND a.rk = u.lo
       JOIN r b ON b.event_type = u.event_type AND b.rk = u.hi""")
def agg_22(spark, d):
    q = A.quantiles(_ev(spark, d), "value", ["event_type"])
    return q.select("event_type", "p", "quantile", "n", "min", "max")


@register("agg_23_window_max_event_time", f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, max(epoch_us(ts)) AS max_event_us
FROM events GROUP BY 1, 2""")
def agg_23(spark, d):
    w = W.tumbling(_ev(spark, d), "1 hour")
    return A.window_aggregate(w, "window", [], [W.micros(F.max("ts")).alias("max_event_us")])


def _sumsq_init():
    return 0.0


def _sumsq_add(state, values):
    v = values.astype("float64")
    return state + float((v * v).sum())


def _sumsq_merge(a, b):
    return a + b


@register("agg_24_user_defined_aggregate", with_views("""
SELECT ip_pair % 10 AS k, CAST(sum(rtt * rtt) AS DOUBLE) AS agg FROM pings GROUP BY 1""", "pings"))
def agg_24(spark, d):
    p = X.pings(_ev(spark, d)).select((F.col("ip_pair") % 10).alias("k"), "rtt")
    return A.combine_aggregate(p, ["k"], "rtt", _sumsq_init, _sumsq_add, _sumsq_merge)


alias("udf_3_aggregate_function", "agg_24_user_defined_aggregate")


@register("udf_9_keyed_window_reduce", with_views(f"""
SELECT {ws()} AS window_start, ip_pair % 10 AS k, CAST(sum(rtt * rtt) AS DOUBLE) AS agg
FROM pings GROUP BY 1, 2""", "pings"))
def udf_9(spark, d):
    w = W.tumbling(X.pings(_ev(spark, d)), "1 hour")
    p = w.select(W.micros("window.start").alias("window_start"),
                 (F.col("ip_pair") % 10).alias("k"), "rtt")
    return A.combine_aggregate(p, ["window_start", "k"], "rtt", _sumsq_init, _sumsq_add, _sumsq_merge)


alias("udf_4_whole_window_function", "udf_9_keyed_window_reduce")


@register("agg_25_chained_aggregate", f"""
WITH a AS (SELECT {ws()} AS ws1, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT ((ws1 + {H} - 1) // {D}) * {D} AS window_start, ((ws1 + {H} - 1) // {D}) * {D} + {D} AS window_end,
       count(*) AS active_user_hours, CAST(sum(n) AS BIGINT) AS events, max(n) AS max_per_user_hour
FROM a GROUP BY 1, 2""")
def agg_25(spark, d):
    first = _ev(spark, d).groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    second = first.groupBy(F.window(F.window_time("window"), "1 day")) \
                  .agg(F.count(F.lit(1)).alias("active_user_hours"), F.sum("n").alias("events"),
                       F.max("n").alias("max_per_user_hour"))
    return second.select(*W.bounds("window"), "active_user_hours", "events", "max_per_user_hour")


# ---------------------------------------------------------------- windows


@register("win_3_row_windows", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
w AS (SELECT event_id, i, unnest(range(greatest(0, CAST(floor((i - 50) / 20.0) AS BIGINT) + 1),
                                        i // 20 + 1)) AS win_id FROM r)
SELECT win_id, count(*) AS cnt, CAST(sum(event_id) AS BIGINT) AS sum_id, min(i) AS first_idx FROM w GROUP BY 1""")
def win_3(spark, d):
    r = W.row_windows(_ev(spark, d), 50, 20, ["ts", "event_id"])
    return r.groupBy("win_id").agg(F.count(F.lit(1)).alias("cnt"), F.sum("event_id").alias("sum_id"),
                                   F.min("row_idx").alias("first_idx"))


SESSION_GAP = "12 hours"
_GAP_US = W.to_us(SESSION_GAP)


@register("win_5_session_windows", f"""
WITH o AS (SELECT user_id, epoch_us(ts) AS t,
                  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            < {_GAP_US} THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(t) AS session_start, max(t) + {_GAP_US} AS session_end, count(*) AS n
FROM s GROUP BY user_id, sid""")
def win_5(spark, d):
    return W.session_aggregate(_ev(spark, d), SESSION_GAP, ["user_id"], {"n": ("cnt", None)})


@register("win_5_session_stream", ORACLES["win_5_session_windows"])
def win_5_stream(spark, d):
    """Session windows as an append-mode stream over events that arrive up to an hour late."""
    def sessions(s):
        w = W.session(s.withWatermark("ts", "1 hour"), SESSION_GAP)
        g = w.groupBy("session", "user_id").agg(F.count(F.lit(1)).alias("n"))
        return g.select("user_id", W.micros("session.start").alias("session_start"),
                        W.micros(W.session_end("session")).alias("session_end"), "n")

    return runner.replay(_ev(spark, d), "sessions", lambda s, base: runner.run_to_table(sessions(s), "sessions", base=base),
                         jitter_us=params.HOUR_US)


@register("win_7_processing_time_window", """
SELECT event_type, count(*) AS cnt, true AS in_run FROM events GROUP BY 1""")
def win_7(spark, d):
    """Wall-clock windows over four drops, in complete mode.  The windows differ from run to run, so the
    query returns what does not: rows per type over all windows, and whether every window is of this run."""
    ev, size_s = _ev(spark, d).select("event_id", "event_type", "ts"), 2
    now = lambda: spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    began = now()

    def run(s, base):
        g = W.processing_time(s, f"{size_s} seconds").groupBy("window", "event_type").agg(F.count(F.lit(1)).alias("cnt"))
        return runner.run_complete(g.select(*W.bounds("window"), "event_type", "cnt"), "wall", base=base)

    out = runner.replay(ev, "wall", run, slices=4, close=False)
    inside = (F.col("window_end") > F.lit(began)) & (F.col("window_start") <= F.lit(now()))
    return out.groupBy("event_type").agg(F.sum("cnt").alias("cnt"), F.bool_and(inside).alias("in_run"))


@register("win_8_window_assign", f"""
SELECT event_id, {ws()} AS window_start, {ws()} + {H} AS window_end FROM events""")
def win_8(spark, d):
    return W.tumbling(_ev(spark, d), "1 hour").select("event_id", *W.bounds("window"))


@register("win_9_window_group_by_key", f"""
SELECT {ws()} AS window_start, user_id,
       row_number() OVER (PARTITION BY {ws()}, user_id ORDER BY ts, event_id) - 1 AS pos, event_id
FROM events""")
def win_9(spark, d):
    w = W.tumbling(_ev(spark, d), "1 hour").select(W.micros("window.start").alias("window_start"),
                                                   "user_id", "ts", "event_id")
    return W.row_index(w, ["ts", "event_id"], ["window_start", "user_id"], out="pos") \
            .select("window_start", "user_id", "pos", "event_id")


@register("win_11_global_window", f"""
SELECT event_type, count(*) AS cnt, CAST(sum({V100}) AS BIGINT) AS sum_v FROM events GROUP BY 1""")
def win_11(spark, d):
    return _v100(_ev(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"),
                                                         F.sum("v100").alias("sum_v"))


_OFF = 15 * 60 * 1_000_000


@register("win_12_window_origin_offset", f"""
SELECT {ws(H, _OFF)} AS window_start, {ws(H, _OFF)} + {H} AS window_end, count(*) AS cnt
FROM events GROUP BY 1, 2""")
def win_12(spark, d):
    w = W.tumbling(_ev(spark, d), "1 hour", origin="15 minutes")
    return A.window_aggregate(w, "window", [], [F.count(F.lit(1)).alias("cnt")])


# ---------------------------------------------------------------- order, sets


@register("top_2_order_by_window", f"""
SELECT {ws()} AS window_start, count(*) AS cnt FROM events GROUP BY 1""")
def top_2(spark, d):
    w = W.tumbling(_ev(spark, d), "1 hour")
    return w.groupBy("window").agg(F.count(F.lit(1)).alias("cnt")) \
            .orderBy("window.start").select(W.micros("window.start").alias("window_start"), "cnt")


@register("set_1_union_streams", f"""
SELECT {ws(D)} AS window_start, event_type, count(*) AS cnt FROM events
WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2""")
def set_1(spark, d):
    ev = _ev(spark, d)
    parts = [ev.filter(F.col("event_type") == t) for t in ("view", "click", "purchase")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = W.tumbling(u, "1 day")
    return w.groupBy(W.micros("window.start").alias("window_start"), "event_type") \
            .agg(F.count(F.lit(1)).alias("cnt"))


@register("set_2_first_n_records",
          "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
def set_2(spark, d):
    # the limit is the feature: read only the first N records of the source
    return _ev(spark, d).select("event_id", "user_id").orderBy("event_id").limit(1000)


# ---------------------------------------------------------------- scalar functions


@register("fn_1_int_arithmetic", """
SELECT event_id, user_id + event_id + 7 AS s, user_id * 3 * 2 AS m, event_id - user_id - 1 AS d,
       (event_id // 7) // 2 AS q FROM events""")
def fn_1(spark, d):
    return _ev(spark, d).select("event_id", E.int_add("user_id", "event_id", F.lit(7)).alias("s"),
                                E.int_mul("user_id", F.lit(3), F.lit(2)).alias("m"),
                                E.int_sub("event_id", "user_id", F.lit(1)).alias("d"),
                                E.int_div("event_id", F.lit(7), F.lit(2)).alias("q"))


@register("fn_2_float_arithmetic",
          "SELECT event_id, value * 1.5 AS m, value / 4.0 AS q FROM events")
def fn_2(spark, d):
    return _ev(spark, d).select("event_id", E.float_mul("value", F.lit(1.5)).alias("m"),
                                E.float_div("value", F.lit(4.0)).alias("q"))


@register("fn_3_refs_and_constants", """
SELECT event_id, CAST(user_id AS INTEGER) AS uid, CAST(value AS DOUBLE) AS v, CAST(5 AS INTEGER) AS c_int,
       CAST(7 AS BIGINT) AS c_long, CAST(2.5 AS DOUBLE) AS c_double FROM events""")
def fn_3(spark, d):
    return _ev(spark, d).select(E.ref("event_id", "long").alias("event_id"),
                                E.ref("user_id", "int").alias("uid"), E.ref("value", "double").alias("v"),
                                E.const(5, "int").alias("c_int"), E.const(7, "long").alias("c_long"),
                                E.const(2.5, "double").alias("c_double"))


@register("fn_10_segment", with_views(
    "SELECT vid, r_time, pos // 5280 AS seg_calc FROM position_reports", "position_reports"))
def fn_10(spark, d):
    pr = X.position_reports(_ev(spark, d))
    return pr.select("vid", "r_time", E.segment("pos").alias("seg_calc"))


@register("fn_12_pack_unpack_timestamps", """
SELECT event_id, (event_id << 32) | (user_id & 4294967295) AS packed, event_id AS hi, user_id AS lo
FROM events""")
def fn_12(spark, d):
    p = _ev(spark, d).select("event_id", E.pack_pair("event_id", "user_id").alias("packed"))
    return p.select("event_id", "packed", E.unpack_hi("packed").alias("hi"),
                    E.unpack_lo("packed").alias("lo"))


@register("fn_13_uuid_low64", """
SELECT event_id, event_id * 7919 AS low64 FROM events""")
def fn_13(spark, d):
    u = _ev(spark, d).select("event_id", E.uuid_from_long(F.col("event_id") * 7919).alias("uuid"))
    return u.select("event_id", E.uuid_low64("uuid").alias("low64"))


# ---------------------------------------------------------------- UDF surface


@register("udf_1_pandas_scalar_udf", "SELECT event_id, value * 2.0 + 1.0 AS y FROM events")
def udf_1(spark, d):
    import pandas as pd

    def affine(v: pd.Series) -> pd.Series:
        return v * 2.0 + 1.0
    f = PR.scalar_udf(affine, "double")
    return _ev(spark, d).select("event_id", f("value").alias("y"))


_WORD_RE = re.compile(r"[A-Za-z][A-Za-z']*")


@register("udf_2_flat_map_user_code", """
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, upper(w) AS word FROM
  (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z'']*)', 1)) AS w FROM documents) a) b
GROUP BY 1, 2""")
def udf_2(spark, d):
    import pandas as pd

    def split_words(pdf):
        rows = [(i, w.upper()) for i, t in zip(pdf["doc_id"], pdf["text"]) for w in _WORD_RE.findall(t or "")]
        return pd.DataFrame(rows, columns=["doc_id", "word"])
    docs = load(spark, d, "documents", spread=True).select("doc_id", "text")
    words = PR.par_do(docs, split_words, "doc_id long, word string", rows=16)
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@register("udf_7_custom_operator_transform", with_views(f"""
SELECT {ws()} AS window_start, {ws()} + {H} AS window_end, c.campaign_id, count(*) AS events,
       max(epoch_us(e.ts)) AS last_update_us
FROM ad_events e JOIN campaigns c ON e.ad_id = c.ad_id WHERE starts_with(e.event_type, 'view')
GROUP BY 1, 2, 3""", "ad_events", "campaigns"))
def udf_7(spark, d):
    from paneflow.plans.ysb import ysb_campaign_counts
    return PR.apply_operator(_ev(spark, d), lambda df: ysb_campaign_counts(df))


def _road_tolls(speeds, stopped):
    """User function of UDF-6: the tolls of one window from its segments and those with a stop."""
    out = speeds.merge(stopped.assign(accident=1), on=["window_end", "xway", "seg"], how="left")
    out["accident"] = out["accident"].fillna(0).astype("int32")
    over = out["vehicles"] - params.LRB_TOLL_THRESHOLD
    due = (over > 0) & (out["avg_speed"] < 40) & (out["accident"] == 0)
    out["toll"] = (2 * over * over).where(due, 0)
    return out[["window_end", "xway", "seg", "vehicles", "avg_speed", "toll", "accident"]]


@register("udf_6_join_cogroup_functions", ORACLES["q_lrb1"])
def udf_6(spark, d):
    """Q-LRB1 with its toll rule as a user function over the cogroup of a window's segments.  Both sides are
    aggregated before, so a group holds at most one row per segment of the road network."""
    rep = lrb.reports(_ev(spark, d))
    both = J.window_equi_join(lrb.segment_vehicles(rep), lrb.segment_speed(rep), ["xway", "seg", "window_end"])
    return J.cogroup_apply(both, lrb.accident_windows(rep), ["window_end"], _road_tolls,
                           "window_end long, xway long, seg long, vehicles long, avg_speed double, toll long, accident int")


@register("agg_4_grouped_window_aggregate", f"""
SELECT {ws(D)} AS window_start, {ws(D)} + {D} AS window_end, CAST(user_id % 3 AS INTEGER) AS k_int, event_id % 5 AS k_long,
       CAST(CAST(floor(value / 64) / 4 AS FLOAT) AS DOUBLE) AS k_float, user_id % 2 AS k_hi, event_id % 2 AS k_lo,
       count(*) AS cnt, CAST(sum({V100}) AS BIGINT) AS sum_v
FROM events GROUP BY ALL""")
def agg_4(spark, d):
    """Keys of every type: int, long, float and a 128-bit pair."""
    keyed = _v100(_ev(spark, d)).select(
        "ts", "v100", (F.col("user_id") % 3).cast("int").alias("k_int"), (F.col("event_id") % 5).alias("k_long"),
        (F.floor(F.col("value") / 64) / 4).cast("float").alias("k_float"),
        F.struct((F.col("user_id") % 2).alias("hi"), (F.col("event_id") % 2).alias("lo")).alias("k_wide"))
    g = A.window_aggregate(W.tumbling(keyed, "1 day"), "window", ["k_int", "k_long", "k_float", "k_wide"],
                           [F.count(F.lit(1)).alias("cnt"), F.sum("v100").alias("sum_v")])
    return g.select("window_start", "window_end", "k_int", "k_long", F.col("k_float").cast("double").alias("k_float"),
                    F.col("k_wide.hi").alias("k_hi"), F.col("k_wide.lo").alias("k_lo"), "cnt", "sum_v")
