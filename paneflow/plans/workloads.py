"""Cluster-monitoring workloads (Q-W1, Q-W2, Q-W3) over ``cluster_events``.

* W1: deep arithmetic projection (``3*x/2`` nested 100 times) → count per
  (window, event type) — the projection is one folded expression inside
  whole-stage codegen.
* W2: projection (depth 1) → ungrouped windowed sum.
* W3: failed-task filter with a 500-way OR inside an AND; the OR is built as a
  balanced tree so analysis stays O(n log n) and the filter compiles into one
  codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.functions import predicates as P
from paneflow.operators import aggregate as A
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load

WIN = params.NYT_WINDOW
WIN_US = W.to_us(WIN)
DEPTH_W1, DEPTH_W2 = 100, 1


def w1(lineitem: DataFrame, depth: int = DEPTH_W1, window=WIN) -> DataFrame:
    """Q-W1: projection → grouped count per window."""
    ce = X.cluster_events(lineitem)
    proj = ce.select("ts", E.nested_projection("cpu", depth).alias("x"), "event_type")
    w = W.tumbling(proj, window)
    return A.window_aggregate(w, "window", ["event_type"], [F.count("x").alias("cnt")])


def w2(lineitem: DataFrame, depth: int = DEPTH_W2, window=WIN) -> DataFrame:
    """Q-W2: projection → ungrouped windowed sum (exact: summed as decimal)."""
    ce = X.cluster_events(lineitem)
    proj = ce.select("ts", E.nested_projection("cpu", depth).alias("x"))
    w = W.tumbling(proj, window)
    return A.window_aggregate(w, "window", [], [
        F.sum(F.col("x").cast("decimal(38,6)")).cast("double").alias("sum_x")])


def w3(lineitem: DataFrame, n_or: int = 500) -> DataFrame:
    """Q-W3: failed-task filter."""
    ce = X.cluster_events(lineitem)
    return ce.filter(P.failed_task_predicate(n_or)).select(
        "job_id", "task_id", W.micros("ts").alias("ts_us"), "cpu", "ram", "disk")


def _nested_sql(x: str, depth: int) -> str:
    e = f"CAST({x} AS DOUBLE)"
    for _ in range(depth):
        e = f"(3.0 * {e} / 2.0)"
    return e


_WS = f"(epoch_us(ts) // {WIN_US}) * {WIN_US}"

SQL_W1 = with_views(f"""
SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end, event_type, count({_nested_sql('cpu', DEPTH_W1)}) AS cnt
FROM cluster_events GROUP BY 1, 2, 3""", "cluster_events")

SQL_W2 = with_views(f"""
SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end,
       CAST(sum(CAST({_nested_sql('cpu', DEPTH_W2)} AS DECIMAL(38, 6))) AS DOUBLE) AS sum_x
FROM cluster_events GROUP BY 1, 2""", "cluster_events")

SQL_W3 = with_views(f"""
SELECT job_id, task_id, epoch_us(ts) AS ts_us, cpu, ram, disk FROM cluster_events
WHERE event_type = 3 AND (cpu < 0 OR ram < 0 OR disk < 0 OR cpu >= 0)""", "cluster_events")

SQL_PRJ2 = with_views(f"""SELECT job_id, task_id, {_nested_sql('cpu', DEPTH_W1)} AS x FROM cluster_events""",
                      "cluster_events")


@register("q_w1", SQL_W1)
def q_w1(spark, d):
    return w1(load(spark, d, "lineitem"))


@register("q_w2", SQL_W2)
def q_w2(spark, d):
    return w2(load(spark, d, "lineitem"))


@register("q_w3", SQL_W3)
def q_w3(spark, d):
    return w3(load(spark, d, "lineitem"))


@register("prj_2_deep_arithmetic_projection", SQL_PRJ2)
def prj_2(spark, d):
    ce = X.cluster_events(load(spark, d, "lineitem"))
    return ce.select("job_id", "task_id", E.nested_projection("cpu", DEPTH_W1).alias("x"))


alias("flt_6_500_way_or", "q_w3")
alias("agg_7_ungrouped_reduction", "q_w2")
