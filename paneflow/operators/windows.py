"""Window assignment (WIN-1 … WIN-13).

Time windows are Spark's own ``window`` / ``session_window`` expressions so that the
same call works on batch and streaming frames and stays inside whole-stage codegen.
Row-count windows need a global (or per-key) row index; :func:`row_index` computes it
without ever funnelling rows through one partition (quantile buckets of the order
column + per-bucket offsets), so a key holding a third of all rows is still spread
over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.session import cut_lineage

_UNITS_US = {
    "microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000,
}

def to_us(d: str | int | float) -> int:
    """Duration → microseconds.  Numbers are seconds; strings are '<n> <unit>'."""
    if isinstance(d, (int, float)):
        return int(round(d * 1_000_000))
    total = 0
    for n, unit in re.findall(r"(\d+(?:\.\d+)?)\s*([a-z]+)", d.lower()):
        unit = unit.rstrip("s") if unit not in ("ms", "us") else unit
        unit = {"ms": "millisecond", "us": "microsecond", "sec": "second",
                "min": "minute"}.get(unit, unit)
        total += int(round(float(n) * _UNITS_US[unit]))
    if total <= 0:
        raise ValueError(f"bad duration {d!r}")
    return total


def dur(d: str | int | float) -> str:
    """Duration → the string form Spark's window functions accept."""
    return f"{to_us(d)} microseconds"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Timestamp → epoch microseconds (bigint): how window bounds leave a query."""
    return F.unix_micros(col_of(c))


def bounds(window_col: str = "window", prefix: str = "window") -> list[Column]:
    """``window`` struct → ``<prefix>_start``, ``<prefix>_end`` as epoch µs."""
    w = F.col(window_col)
    return [micros(w.start).alias(f"{prefix}_start"), micros(w.end).alias(f"{prefix}_end")]


# ---------------------------------------------------------------- time windows

def tumbling(df: DataFrame, size, ts: str = "ts", origin=None, out: str = "window") -> DataFrame:
    """WIN-1 / WIN-8 / WIN-12: assign each row its tumbling event-time window."""
    start = dur(origin) if origin else None
    w = F.window(ts, dur(size), startTime=start) if start else F.window(ts, dur(size))
    return df.withColumn(out, w)


def sliding(df: DataFrame, size, slide, ts: str = "ts", origin=None, out: str = "window",
            stream_start=None) -> DataFrame:
    """WIN-2: sliding event-time windows (one output row per covering window).

    ``stream_start`` (a timestamp string) drops windows that open before the stream
    began, as an engine counting windows from t=0 does; Spark's ``window`` would
    otherwise emit the ``size/slide - 1`` partial leading windows.
    """
    args = [ts, dur(size), dur(slide)]
    if origin:
        args.append(dur(origin))
    r = df.withColumn(out, F.window(*args))
    if stream_start is not None:
        r = r.filter(F.col(f"{out}.start") >= F.lit(stream_start).cast("timestamp"))
    return r


def processing_time(df: DataFrame, size, out: str = "window") -> DataFrame:
    """WIN-7: tumbling window on the wall clock at processing time."""
    return df.withColumn("proc_ts", F.current_timestamp()) \
             .withColumn(out, F.window("proc_ts", dur(size)))


def session(df: DataFrame, gap, ts: str = "ts", out: str = "session",
            touching_merges: bool = False) -> DataFrame:
    """WIN-5: session windows.

    Every row covers ``[ts, ts + gap)``; overlapping rows merge (out-of-order rows can
    bridge two sessions).  Spark's ``session_window`` also merges windows that only
    touch (``ts == end``); the default here keeps them apart, which is done with a
    gap one microsecond shorter and the end moved back by that microsecond.
    """
    g = to_us(gap)
    if touching_merges:
        return df.withColumn(out, F.session_window(ts, f"{g} microseconds"))
    sw = F.session_window(ts, f"{g - 1} microseconds")
    return df.withColumn(out, sw)


def session_end(window_col: str = "session", touching_merges: bool = False) -> Column:
    """End of a session produced by :func:`session` (undoes the 1 µs shift)."""
    e = F.col(f"{window_col}.end")
    return e if touching_merges else e + F.expr("INTERVAL 1 MICROSECOND")


def custom(df: DataFrame, assign: Callable[[Column], Column], ts: str = "ts",
           out: str = "window") -> DataFrame:
    """WIN-13: pluggable window assignment.

    ``assign(ts)`` returns ``array<struct<start: timestamp, end: timestamp>>``; the row
    is repeated once per window (explode is a narrow operation, no shuffle).
    """
    return df.withColumn(out, F.explode(assign(F.col(ts))))


def every_n_windows(size, slide) -> Callable[[Column], Column]:
    """Example assigner for :func:`custom`: sliding windows built from array functions."""
    s, d = to_us(size), to_us(slide)

    def assign(ts: Column) -> Column:
        t = micros(ts)
        last = t - (t % d)
        starts = F.sequence(last - F.lit(s - d), last, F.lit(d))
        starts = F.filter(starts, lambda x: x > t - F.lit(s))
        return F.transform(starts, lambda x: F.struct(
            F.timestamp_micros(x).alias("start"), F.timestamp_micros(x + F.lit(s)).alias("end")))
    return assign


# ---------------------------------------------------------------- row windows

def _bucket_of(x: Column, bounds: list) -> Column:
    """Index of the bucket holding ``x`` for sorted ``bounds`` (binary-search CASE tree)."""
    def build(lo: int, hi: int) -> Column:
        # buckets lo..hi; bucket i holds bounds[i-1] <= x < bounds[i]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x >= F.lit(bounds[mid - 1]), build(mid, hi)).otherwise(build(lo, mid - 1))
    return build(0, len(bounds))


def row_index(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
              out: str = "row_idx", buckets: int | None = None,
              counts_before: dict[str, Column] | None = None) -> DataFrame:
    """Dense 0-based row index in ``order`` (per ``keys`` group if given), batch only.

    Rows are range-partitioned once on the keys and *all* order columns (any orderable
    type), so a hot key and equal leading values are split over tasks, and stored in the shared
    checkpoint folder.  Their place in the stored partition is then fixed
    (``monotonically_increasing_id``), and the index is that place plus the rows of the
    key in earlier partitions, a prefix sum over one row per (key, partition).  Nothing is
    sorted twice, and several branches of one plan may read the result.

    ``counts_before`` maps output names to 0/1 expressions; each output is the number of
    rows *before* this one (same key group, same order) for which the expression is 1,
    computed in the same pass (e.g. per-side arrival counts of a merged stream).
    """
    keys, order = list(keys), list(order)
    counts_before = counts_before or {}
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flags = {name: f"_f_{i}" for i, name in enumerate(counts_before)}
    tagged = df.withColumns({flags[name]: c.cast("long") for name, c in counts_before.items()}) if flags else df
    placed = cut_lineage(tagged.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order))
    placed = placed.withColumn("_id", F.monotonically_increasing_id()) \
        .withColumn("_part", F.shiftright("_id", 33)).withColumn("_loc", F.col("_id") - F.shiftleft("_part", 33))
    counts = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first"), *[F.sum(f).alias(f"{f}_s") for f in flags.values()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_off": "_n", **{f"{f}_o": f"{f}_s" for f in flags.values()}}
    # one row per (key, partition): a key has at most ``n`` of them
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first",
                            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(o) for o, c in sums.items()])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    res = placed.join(offsets if keys else F.broadcast(offsets), same) \
        .withColumn(out, F.col("_off") + F.col("_loc") - F.col("_first"))
    if flags:
        run = Window.partitionBy(*keys, "_part").orderBy("_loc").rowsBetween(Window.unboundedPreceding, 0)
        for name, f in flags.items():
            res = res.withColumn(name, F.col(f"{f}_o") + F.sum(f).over(run) - F.col(f))
    return res.drop("_id", "_part", "_loc", "_p", "_first", *sums, *flags.values(), *[f"_k{i}" for i in range(len(keys))])


def row_windows(df: DataFrame, size: int, slide: int, order: Sequence[str],
                keys: Sequence[str] = (), out: str = "win_id",
                complete_only: bool = False) -> DataFrame:
    """WIN-3 / WIN-4: row-count windows (tumbling when ``size == slide``).

    Window ``k`` holds rows with index in ``[k*slide, k*slide + size)``; each row is
    exploded to every window that contains it.  With ``complete_only`` the trailing
    windows with fewer than ``size`` rows are dropped.
    """
    idx = row_index(df, order, keys)
    i = F.col("row_idx")
    lo = F.greatest(F.lit(0), F.floor((i - F.lit(size)) / F.lit(slide)).cast("long") + 1)
    hi = F.floor(i / F.lit(slide)).cast("long")
    r = idx.withColumn(out, F.explode(F.sequence(lo, hi)))
    if complete_only:
        # windows are complete when their last index exists in the (key) group
        grp = list(keys) if keys else ["_all"]
        src = idx if keys else idx.withColumn("_all", F.lit(0))
        last = src.groupBy(*grp).agg(F.max("row_idx").alias("_last"))
        if not keys:
            r = r.withColumn("_all", F.lit(0))
            last = F.broadcast(last)  # one row
        r = r.join(last, grp).filter(F.col(out) * slide + size - 1 <= F.col("_last")) \
             .drop("_last", "_all")
    return r


def count_windows(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = (),
                  out: str = "win_id") -> DataFrame:
    """WIN-4: tumbling count windows over the whole stream: window = row_index div n."""
    idx = row_index(df, order, keys)
    return idx.withColumn(out, F.floor(F.col("row_idx") / F.lit(n)).cast("long"))


def session_aggregate(df: DataFrame, gap, keys: Sequence[str], aggs: dict, ts: str = "ts") -> DataFrame:
    """WIN-5 aggregate with map-side pre-merging (batch).

    Rows of one key less than ``gap`` apart always belong to the same session, so rows
    are first reduced per ``(keys, floor(ts / gap))`` bucket — a partial aggregate
    before any shuffle — to ``(first, last, partials)``.  Each bucket summary covers
    ``[first, last + gap)``; ``session_window`` with a per-row gap then merges the
    summaries exactly as it would merge the raw rows (touching windows stay apart).
    A key holding a third of all rows is shuffled as at most span/gap summaries.

    ``aggs``: output name → (kind, column) with kind in cnt, sum, min, max.
    Output: keys, ``session_start``, ``session_end`` (epoch µs), aggregates.
    """
    g = to_us(gap)
    keys = list(keys)
    t = micros(ts)
    part = [F.min(t).alias("_first"), F.max(t).alias("_last")]
    for name, (kind, c) in aggs.items():
        fn = {"cnt": lambda _c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}[kind]
        part.append(fn(c).alias(f"_p_{name}"))
    summ = df.groupBy(*keys, F.floor(t / F.lit(g)).alias("_gb")).agg(*part)
    span = F.col("_last") - F.col("_first") + F.lit(g - 1)
    gap_col = F.concat(span.cast("string"), F.lit(" microseconds"))
    sw = F.session_window(F.timestamp_micros(F.col("_first")), gap_col)
    fin = []
    for name, (kind, _c) in aggs.items():
        fn = {"cnt": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind]
        fin.append(fn(f"_p_{name}").alias(name))
    s = summ.groupBy(*keys, sw.alias("_s")).agg(F.max("_last").alias("_end_last"), *fin)
    return s.select(*keys, micros("_s.start").alias("session_start"),
                    (F.col("_end_last") + F.lit(g)).alias("session_end"), *aggs.keys())
