"""Linear Road queries (Q-LRB1, Q-LRB2) and their operator rows.

Q-LRB1 (batch form of the windowed dataflow program):

* position reports only (``r_type = 0``), event time ``r_time`` seconds;
* mean speed per (xway, seg) per 5 min; distinct vehicles per (xway, seg) per 1 min;
* the two joined on (xway, seg, window end) — in 30 s join windows a window result
  carries its last instant, so only the minute that ends with the 5-minute window
  matches: one toll per (xway, seg) per 5 min;
* accident flag = a stop event (STR-6) of that (xway, seg) in the 120 s window that
  ends at the same instant (the sliding 120 s / 30 s accident windows);
* clean toll rule: ``2*(n - threshold)^2`` if n > threshold and speed < 40, zero when an
  accident is flagged.  ``compat="reference"`` keeps the published program's behaviour
  (XOR instead of square, toll kept only *with* an accident).

All aggregates are partial/final; the joins run between aggregated tables whose size
is segments × windows, independent of the number of reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.operators import joins as J
from paneflow.operators import stateful as S
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load

# Window lengths of the road queries, in seconds.
SPEED_WINDOW_S = 300
VEHICLE_WINDOW_S = 60
ACCIDENT_WINDOW_S, ACCIDENT_SLIDE_S = 120, 30
TOLL_PASS_S = 300


def reports(events: DataFrame) -> DataFrame:
    """FLT-9 + PRJ-8: position reports, projected to (vid, seg, speed, pos, time, xway) + ts."""
    pr = X.position_reports(events).filter(F.col("r_type") == 0)
    return pr.select("vid", "seg", "speed", "pos", "r_time", "xway",
                     F.timestamp_seconds("r_time").alias("ts"))


def segment_speed(rep: DataFrame) -> DataFrame:
    """AGG-20: mean speed per (xway, seg) per 5-minute tumbling window."""
    w = W.tumbling(rep, f"{SPEED_WINDOW_S} seconds")
    return w.groupBy("xway", "seg", "window").agg(F.avg("speed").alias("avg_speed")) \
            .select("xway", "seg", W.micros("window.end").alias("window_end"), "avg_speed")


def segment_vehicles(rep: DataFrame) -> DataFrame:
    """AGG-21: distinct vehicles per (xway, seg) per 1-minute tumbling window."""
    w = W.tumbling(rep, f"{VEHICLE_WINDOW_S} seconds")
    return w.groupBy("xway", "seg", "window").agg(F.countDistinct("vid").alias("vehicles")) \
            .select("xway", "seg", W.micros("window.end").alias("window_end"), "vehicles")


def accident_windows(rep: DataFrame) -> DataFrame:
    """Stop events assigned to the sliding 120 s / 30 s windows, one row per
    (xway, seg, window end) that holds at least one stop."""
    st = S.stop_events(rep).select("xway", "seg", "ts")
    w = W.sliding(st, f"{ACCIDENT_WINDOW_S} seconds", f"{ACCIDENT_SLIDE_S} seconds")
    return w.select("xway", "seg", W.micros("window.end").alias("window_end")).distinct()


def tolls(events: DataFrame, threshold: int = params.LRB_TOLL_THRESHOLD,
          compat: str = "clean") -> DataFrame:
    """Q-LRB1: toll per (xway, seg) per 5 minutes with the accident rule."""
    rep = reports(events)
    joined = J.window_equi_join(segment_vehicles(rep), segment_speed(rep),
                                ["xway", "seg", "window_end"])            # JN-9
    base = joined.withColumn("toll", E.toll("vehicles", "avg_speed", threshold, compat=compat))
    cg = J.cogroup_exists(base, accident_windows(rep), ["xway", "seg", "window_end"],
                          flag="has_accident")                            # JN-10
    acc = F.col("has_accident")
    if compat == "reference":
        toll = F.when(acc, F.col("toll")).otherwise(F.lit(0))
    else:
        toll = F.when(acc, F.lit(0)).otherwise(F.col("toll"))
    return cg.select("window_end", "xway", "seg", "vehicles", "avg_speed",
                     toll.cast("long").alias("toll"), acc.cast("int").alias("accident"))


def stops(events: DataFrame) -> DataFrame:
    """STR-6: stop events (vid, xway, seg, pos, r_time)."""
    return S.stop_events(reports(events)).select("vid", "xway", "seg", "pos", "r_time")


def accident_pairs(events: DataFrame) -> DataFrame:
    """STR-7: accidents — two stopped vehicles overlapping at one (xway, pos).

    ``end_time`` is -1 while both vehicles are still stopped at the end of the input.
    """
    a = S.accidents(reports(events))
    return a.withColumn("end_time", F.coalesce(F.col("end_time"), F.lit(-1)))


def toll_pass(events: DataFrame, period_s: int = TOLL_PASS_S) -> DataFrame:
    """Q-LRB2 / STR-8: every ``period_s`` seconds, per (xway, seg): cumulative report
    count and mean speed of all reports before the pass instant, and whether an
    accident (STR-7) is active at that instant.

    Reports are aggregated per (xway, seg, period) first; the cumulative values are a
    running sum over those partials (segments × periods rows), never over raw reports.
    """
    rep = reports(events)
    per = rep.groupBy("xway", "seg", F.floor(F.col("r_time") / period_s).cast("long").alias("p")) \
             .agg(F.count(F.lit(1)).alias("n"), F.sum("speed").alias("s"))
    from pyspark.sql import Window
    w = Window.partitionBy("xway", "seg").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select("xway", "seg", ((F.col("p") + 1) * period_s).alias("pass_time"),
                     F.sum("n").over(w).alias("reports"), F.sum("s").over(w).alias("_s"))
    cum = cum.withColumn("avg_speed", F.col("_s") / F.col("reports")).drop("_s")
    acc = S.accidents(rep).select("xway", "seg", "start_time", "end_time")
    # accidents begun before a pass less those ended before it: a sweep over both, linear in
    # passes plus accidents instead of their product per segment
    change = acc.select("xway", "seg", F.col("start_time").alias("t"), F.lit(1).alias("d")).union(
        acc.where(F.col("end_time").isNotNull()).select("xway", "seg", F.col("end_time").alias("t"), F.lit(-1).alias("d")))
    change = change.groupBy("xway", "seg", "t").agg(F.sum("d").alias("d")).withColumn("kind", F.lit(1))
    both = cum.withColumns({"t": F.col("pass_time"), "kind": F.lit(0), "d": F.lit(0).cast("long")}).unionByName(
        change, allowMissingColumns=True)
    sweep = Window.partitionBy("xway", "seg").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("open", F.sum("d").over(sweep)).where(F.col("kind") == 0)
    return out.select("pass_time", "xway", "seg", "reports", "avg_speed", F.when(F.col("open") > 0, 1).otherwise(0).alias("accident"))


def _ev(spark, d):
    return load(spark, d, "events")


# ---------------------------------------------------------------- oracle SQL

_PR = "(SELECT vid, seg, speed, pos, r_time, xway FROM position_reports WHERE r_type = 0)"

_STOPS = f"""
o AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY vid ORDER BY r_time) = pos THEN 0 ELSE 1 END AS chg
      FROM {_PR} pr),
i AS (SELECT *, sum(chg) OVER (PARTITION BY vid ORDER BY r_time ROWS UNBOUNDED PRECEDING) AS isl FROM o),
c AS (SELECT *, 1 + sum(CASE WHEN speed = 0 AND chg = 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY vid, isl ORDER BY r_time ROWS UNBOUNDED PRECEDING) AS cnt FROM i),
st AS (SELECT vid, xway, seg, pos, r_time FROM c WHERE speed = 0 AND chg = 0 AND cnt = 4)"""

SQL_STOPS = with_views(f"WITH {_STOPS}\nSELECT * FROM st", "position_reports")

SQL_SPEED = with_views(f"""
SELECT xway, seg, (r_time // 300) * 300000000 + 300000000 AS window_end, avg(speed) AS avg_speed
FROM {_PR} pr GROUP BY 1, 2, 3""", "position_reports")

SQL_VEHICLES = with_views(f"""
SELECT xway, seg, (r_time // 60) * 60000000 + 60000000 AS window_end, count(DISTINCT vid) AS vehicles
FROM {_PR} pr GROUP BY 1, 2, 3""", "position_reports")


def _sql_tolls(threshold: int, reference: bool = False) -> str:
    n = "v.vehicles"
    raw = (f"xor(2 * ({n} - {threshold}), 2)" if reference
           else f"2 * ({n} - {threshold}) * ({n} - {threshold})")
    keep = "CASE WHEN a.xway IS NULL THEN 0 ELSE t.toll END" if reference else \
           "CASE WHEN a.xway IS NULL THEN t.toll ELSE 0 END"
    return with_views(f"""
WITH {_STOPS},
sp AS (SELECT xway, seg, (r_time // 300) * 300 + 300 AS wend, avg(speed) AS avg_speed FROM {_PR} pr GROUP BY 1, 2, 3),
vh AS (SELECT xway, seg, (r_time // 60) * 60 + 60 AS wend, count(DISTINCT vid) AS vehicles FROM {_PR} pr GROUP BY 1, 2, 3),
t AS (SELECT v.xway, v.seg, v.wend, v.vehicles, s.avg_speed,
             CASE WHEN v.vehicles > {threshold} AND s.avg_speed < 40 THEN {raw} ELSE 0 END AS toll
      FROM vh v JOIN sp s ON v.xway = s.xway AND v.seg = s.seg AND v.wend = s.wend),
a AS (SELECT DISTINCT xway, seg, (r_time // 30) * 30 + 30 * k AS wend
      FROM st, (VALUES (1), (2), (3), (4)) ks(k))
SELECT t.wend * 1000000 AS window_end, t.xway, t.seg, t.vehicles, t.avg_speed,
       CAST({keep} AS BIGINT) AS toll, CASE WHEN a.xway IS NULL THEN 0 ELSE 1 END AS accident
FROM t LEFT JOIN a ON t.xway = a.xway AND t.seg = a.seg AND t.wend = a.wend""", "position_reports")


_ACC = f"""
{_STOPS},
nx AS (SELECT vid, r_time AS start_time,
              min(CASE WHEN speed <> 0 THEN r_time END) OVER (PARTITION BY vid ORDER BY r_time
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_time
       FROM {_PR} pr),
iv AS (SELECT st.vid, st.xway, st.seg, st.pos, st.r_time AS start_time, nx.end_time
       FROM st JOIN nx ON st.vid = nx.vid AND st.r_time = nx.start_time),
acc AS (SELECT a.xway, a.pos, a.seg, a.vid AS vid1, b.vid AS vid2,
               greatest(a.start_time, b.start_time) AS start_time,
               least(a.end_time, b.end_time) AS end_time
        FROM iv a JOIN iv b ON a.xway = b.xway AND a.pos = b.pos AND a.vid < b.vid
         AND a.start_time < coalesce(b.end_time, 4611686018427387904)
         AND b.start_time < coalesce(a.end_time, 4611686018427387904))"""

SQL_ACCIDENTS = with_views(f"""WITH {_ACC}
SELECT xway, pos, seg, vid1, vid2, start_time, coalesce(end_time, -1) AS end_time FROM acc""",
                           "position_reports")

SQL_TOLL_PASS = with_views(f"""
WITH {_ACC},
per AS (SELECT xway, seg, r_time // 300 AS p, count(*) AS n, sum(speed) AS s FROM {_PR} pr GROUP BY 1, 2, 3),
cum AS (SELECT xway, seg, (p + 1) * 300 AS pass_time,
               sum(n) OVER (PARTITION BY xway, seg ORDER BY p ROWS UNBOUNDED PRECEDING) AS reports,
               sum(s) OVER (PARTITION BY xway, seg ORDER BY p ROWS UNBOUNDED PRECEDING) AS s FROM per),
hit AS (SELECT DISTINCT c.xway, c.seg, c.pass_time FROM cum c JOIN acc a ON c.xway = a.xway AND c.seg = a.seg
        WHERE a.start_time < c.pass_time AND coalesce(a.end_time, 4611686018427387904) >= c.pass_time)
SELECT c.pass_time, c.xway, c.seg, CAST(c.reports AS BIGINT) AS reports, c.s / c.reports AS avg_speed,
       CASE WHEN h.xway IS NULL THEN 0 ELSE 1 END AS accident
FROM cum c LEFT JOIN hit h ON c.xway = h.xway AND c.seg = h.seg AND c.pass_time = h.pass_time""",
                           "position_reports")

SQL_REPORTS = with_views(f"""
SELECT vid, seg, speed, pos, r_time, xway, epoch_us(to_timestamp(r_time)) AS ts_us FROM {_PR} pr""",
                         "position_reports")


@register("q_lrb1", _sql_tolls(params.LRB_TOLL_THRESHOLD))
def q_lrb1(spark, d):
    return tolls(_ev(spark, d))


@register("q_lrb1_reference_compat", _sql_tolls(params.LRB_TOLL_THRESHOLD, reference=True))
def q_lrb1_ref(spark, d):
    return tolls(_ev(spark, d), compat="reference")


@register("q_lrb2", SQL_TOLL_PASS)
def q_lrb2(spark, d):
    return toll_pass(_ev(spark, d))


@register("agg_20_lrb_segment_speed", SQL_SPEED)
def agg_20(spark, d):
    return segment_speed(reports(_ev(spark, d)))


@register("agg_21_lrb_distinct_vehicles", SQL_VEHICLES)
def agg_21(spark, d):
    return segment_vehicles(reports(_ev(spark, d)))


@register("str_6_stop_detector", SQL_STOPS)
def str_6(spark, d):
    return stops(_ev(spark, d))


@register("str_7_accident_detection", SQL_ACCIDENTS)
def str_7(spark, d):
    return accident_pairs(_ev(spark, d))


@register("prj_8_lrb_projection", SQL_REPORTS)
def prj_8(spark, d):
    r = reports(_ev(spark, d))
    return r.select("vid", "seg", "speed", "pos", "r_time", "xway", W.micros("ts").alias("ts_us"))


alias("flt_9_position_reports_filter", "prj_8_lrb_projection")
alias("jn_9_window_equi_join", "q_lrb1")
alias("jn_10_window_cogroup", "q_lrb1")
alias("fn_11_toll_formula", "q_lrb1_reference_compat")
alias("str_8_toll_pass", "q_lrb2")
