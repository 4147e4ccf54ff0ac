"""The theta joins deal out their pairs, which the bytes of their sides say nothing about."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paneflow.operators import joins as J

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def _side(n: int, seed: int) -> list[tuple]:
    """Rows within a few hours of each other: ends of the range to the microsecond, rows that come twice, nulls, NaN."""
    random.seed(seed)
    exact = [T0, T0 + 2 * HOUR, T0 + 2 * HOUR + dt.timedelta(microseconds=1), T0 - 2 * HOUR, T0 - 2 * HOUR - dt.timedelta(microseconds=1)]
    out = [(k, exact[k % 5] if k < 20 else T0 + dt.timedelta(seconds=random.randint(0, 30_000)), float(random.randint(0, 50))) for k in range(n)]
    return [*out, *out[:15], (n, None, 1.0), (n + 1, T0, None), (n + 2, T0, math.nan), (None, T0, 5.0)]


def _less(x, y) -> bool:
    return x is not None and y is not None and not math.isnan(x) and (math.isnan(y) or x < y)


def _pairs(left: list, right: list, offset: float) -> Counter:
    return Counter((a[0], b[0]) for a in left for b in right
                   if a[1] and b[1] and a[1] - 2 * HOUR <= b[1] <= a[1] + 2 * HOUR and a[2] is not None and _less(a[2] + offset, b[2]))


@pytest.mark.parametrize("form", ["range", "less"])
def test_pairs_are_dealt_to_every_core(spark, form):
    """a few KB of rows make many pairs; they came together in the few tasks that their bytes asked for."""
    left, right = _side(300, 1), _side(300, 2)
    l_, r_ = (spark.createDataFrame(x, "event_id long, ts timestamp_ntz, value double").withColumn("ts", F.col("ts").cast("timestamp")) for x in (left, right))
    if form == "range":
        got = J.theta_join_range(l_, r_, "2 hours", "2 hours", predicate=lambda a, b: a("value") + F.lit(-3.0) < b("value"))
    else:
        got = J.theta_join_less(l_, r_, "2 hours", "2 hours", "value", -3.0)
    rows = got.select("l_event_id", "r_event_id", F.spark_partition_id().alias("p")).collect()
    assert Counter((r[0], r[1]) for r in rows) == _pairs(left, right, -3.0)
    tasks = Counter(r[2] for r in rows)
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(tasks.values()) < len(rows) / 5


@pytest.mark.parametrize("lower, upper", [(True, True), (True, False), (False, True), (False, False)])
def test_ends_of_the_range(spark, lower, upper):
    """A pair compares microseconds, not timestamps moved by an interval; open and closed ends are as flagged."""
    us = dt.timedelta(microseconds=1)
    right = [(0, T0 - HOUR - us), (1, T0 - HOUR), (2, T0 - HOUR + us), (3, T0 + HOUR - us), (4, T0 + HOUR), (5, T0 + HOUR + us)]
    l_, r_ = (spark.createDataFrame(x, "id long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp")) for x in ([(9, T0)], right))
    for keys in ([], ["k"]):
        got = J.interval_join(l_.withColumn("k", F.lit(1)), r_.withColumn("k", F.lit(1)), keys, "1 hour", "1 hour", lower_inclusive=lower, upper_inclusive=upper)
        assert "INTERVAL" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["r_id"] for r in got.collect()) == [1] * lower + [2, 3] + [4] * upper


def _shuffled(df) -> int:
    """Records written to the shuffles of a plan that has run."""
    def walk(node) -> int:
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        mine = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        return mine + sum(walk(node.children().apply(k)) for k in range(node.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def _spread(spark, n: int, seed: int):
    random.seed(seed)
    rows = [(k, T0 + dt.timedelta(seconds=random.randint(0, 30 * 86_400)), float(random.randint(0, 50))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("form", ["range", "less"])
def test_rows_travel_once_per_bucket(spark, form):
    """a right row went to all parts of its bucket, busy or not, and in theta_join_less to its nodes besides."""
    (left, l_), (right, r_) = _spread(spark, 2_000, 3), _spread(spark, 2_000, 4)
    if form == "range":
        got = J.theta_join_range(l_, r_, "2 hours", "2 hours", predicate=lambda a, b: a("value") < b("value"), order="value")
    else:
        got = J.theta_join_less(l_, r_, "2 hours", "2 hours", "value")
    got = got.select("l_event_id", "r_event_id")
    assert Counter(map(tuple, got.collect())) == _pairs(left, right, 0.0)
    assert 5 * len(left) < _shuffled(got) <= 6.2 * len(left)


@pytest.mark.parametrize("form", ["range", "less"])
def test_cells_of_a_busy_bucket(spark, monkeypatch, form):
    """A bucket with most pairs is cut on both sides, a cell holds ``CELL_ROWS`` rows of a side, and no pair is lost or made twice."""
    monkeypatch.setattr(J, "CELL_ROWS", 50)
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    (left, l_), (right, r_) = _spread(spark, 200, 5), _spread(spark, 300, 6)
    hot = [(1_000 + k, T0 + HOUR, float(k % 9)) for k in range(400)]
    h_ = spark.createDataFrame([*hot, (None, None, 3.0), (None, T0 + HOUR, None)], "event_id long, ts timestamp_ntz, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    left, right, l_, r_ = left + hot, right + hot[:100], l_.union(h_), r_.union(h_.where("event_id < 1100"))
    if form == "range":
        got = J.theta_join_range(l_, r_, "2 hours", "2 hours", predicate=lambda a, b: a("value") < b("value"))
    else:
        got = J.theta_join_less(l_, r_, "2 hours", "2 hours", "value")
    assert Counter(map(tuple, got.select("l_event_id", "r_event_id").collect())) == _pairs(left, right, 0.0)
    sides = [x.select(F.lit(7).cast("long").alias("_b")) for x in (l_, r_)]
    (lefts, rights), = J._grids(*sides).values()
    assert lefts >= l_.count() / 50 and rights >= r_.count() / 50


def test_sides_without_rows(spark):
    _, l_ = _spread(spark, 20, 7)
    assert J.theta_join_less(l_, l_.limit(0), "2 hours", "2 hours", "value").count() == 0
    assert J.theta_join_range(l_.limit(0), l_, "2 hours", "2 hours").count() == 0
