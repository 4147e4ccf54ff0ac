"""NYC taxi queries (Q-NYT1, Q-NYT2): long trips of 'V' vendors per region per window.

Filter ``distance > 5 AND vendor LIKE 'V%'`` is pushed into the Parquet scan of
``lineitem`` through the view's projection; region = FN-9 geo cell; aggregates are
count, total (integer-truncated) distance and mean distance, partial/final per
(window, region) — 100 regions, so the shuffle carries ≤ 100 rows per task and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.operators import aggregate as A
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load

MIN_DISTANCE = 5.0  # fixed query constant
WIN = params.NYT_WINDOW
WIN_US = W.to_us(WIN)


def long_v_trips(trips: DataFrame) -> DataFrame:
    """FLT-10: ``trip_distance > 5 AND vendor_id LIKE 'V%'``, with the FN-9 region."""
    return trips.filter((F.col("trip_distance") > MIN_DISTANCE) & F.col("vendor_id").startswith("V")) \
                .withColumn("region", E.geo_cell("pickup_long", "pickup_lat"))


def _aggs():
    return [F.count(F.lit(1)).alias("trips"),
            F.sum(F.col("trip_distance").cast("long")).alias("total_distance"),
            F.avg("trip_distance").alias("avg_distance")]


def trips_per_region(lineitem: DataFrame, window=WIN) -> DataFrame:
    """Q-NYT1 / AGG-11."""
    t = W.tumbling(long_v_trips(X.trips(lineitem)), window, ts="pickup_ts")
    return A.window_aggregate(t, "window", ["region"], _aggs())


def trips_per_region_count_window(lineitem: DataFrame, n: int = params.COUNT_WINDOW_ROWS) -> DataFrame:
    """Q-NYT2: same over count windows of ``n`` trips that pass the filter (pickup order)."""
    t = W.count_windows(long_v_trips(X.trips(lineitem)), n, ["pickup_ts", "trip_id", "leg"])
    return t.groupBy("win_id", "region").agg(*_aggs())


_GEO = ("(CAST(trunc((pickup_long + 750.0) * 100.0) AS BIGINT) + "
        "12345 * CAST(trunc((pickup_lat + 1400.0) * 100.0) AS BIGINT)) % 100")
_FILTER = "trip_distance > 5.0 AND starts_with(vendor_id, 'V')"
_AGGS = ("count(*) AS trips, CAST(sum(CAST(trunc(trip_distance) AS BIGINT)) AS BIGINT) AS total_distance, "
         "avg(trip_distance) AS avg_distance")
_WS = f"(epoch_us(pickup_ts) // {WIN_US}) * {WIN_US}"

SQL_NYT1 = with_views(f"""
SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end, {_GEO} AS region, {_AGGS}
FROM trips WHERE {_FILTER} GROUP BY 1, 2, 3""", "trips")

SQL_NYT2 = with_views(f"""
SELECT win_id, {_GEO} AS region, {_AGGS}
FROM (SELECT *, (row_number() OVER (ORDER BY pickup_ts, trip_id, leg) - 1) // {params.COUNT_WINDOW_ROWS} AS win_id
      FROM trips WHERE {_FILTER}) t
GROUP BY 1, 2""", "trips")

SQL_GEO = with_views(f"SELECT trip_id, leg, {_GEO} AS region FROM trips", "trips")


@register("q_nyt1", SQL_NYT1)
def q_nyt1(spark, d):
    return trips_per_region(load(spark, d, "lineitem"))


@register("q_nyt2", SQL_NYT2)
def q_nyt2(spark, d):
    return trips_per_region_count_window(load(spark, d, "lineitem"))


@register("fn_9_geo_cell", SQL_GEO)
def fn_9(spark, d):
    t = X.trips(load(spark, d, "lineitem"))
    return t.select("trip_id", "leg", E.geo_cell("pickup_long", "pickup_lat").alias("region"))


alias("agg_11_nyt_trips_per_region", "q_nyt1")
alias("flt_10_trip_filter", "q_nyt1")
