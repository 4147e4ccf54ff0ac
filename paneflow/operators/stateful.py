"""Keyed stateful detectors (STR-6 … STR-8), batch forms.

The streaming forms (``transformWithStateInPandas``) live in
:mod:`paneflow.streaming.processors`; these are the batch equivalents written as
window functions (gaps-and-islands) and joins, which Spark runs as sort-based
window operators per key and hash joins — no Python on the hot path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STOP_REPORTS = 4  # consecutive reports at one position that make a stop (fixed value)
CHUNK = 86_400    # time units of a chunk: what one task sorts of a vehicle's reports


def _by_chunk(reports: DataFrame, vid: str, time: str, chunk: int):
    """Reports with their time chunk, and the window over one (vehicle, chunk)."""
    r = reports.withColumn("_c", F.floor(F.col(time) / F.lit(chunk)).cast("long"))
    return r, Window.partitionBy(vid, "_c").orderBy(time)


def _with_chunk(rows: DataFrame, summary: DataFrame, vid: str) -> DataFrame:
    """Rows joined to the summary of their (vehicle, chunk); a null vehicle is a vehicle."""
    s = summary.withColumnsRenamed({vid: "_sv", "_c": "_sc"})
    return rows.join(s, F.col(vid).eqNullSafe(F.col("_sv")) & (F.col("_c") == F.col("_sc"))).drop("_sv", "_sc")


def stop_events(reports: DataFrame, vid: str = "vid", time: str = "r_time",
                pos: str = "pos", speed: str = "speed", n: int = STOP_REPORTS,
                chunk: int = CHUNK) -> DataFrame:
    """STR-6: per vehicle, in time order, the report at which it has been seen ``n``
    times in a row at one position with speed 0 after the first sighting.

    A change of position starts a new run (the first report of a run counts 1 whatever
    its speed); each later zero-speed report at that position adds one; the detector
    fires once, at the report that brings the run to ``n``.  Output: the firing report's columns.

    Runs are counted within (vehicle, time chunk), so no task sorts a vehicle's whole
    history.  One summary row per chunk (first and last position, counts of the first and
    last run) is then stitched per vehicle: a run that goes on in the next chunk carries its count.
    """
    r, w = _by_chunk(reports, vid, time, chunk)
    r = r.withColumn("_chg", F.when(F.lag(pos).over(w) == F.col(pos), 0).otherwise(1))
    r = r.withColumn("_isl", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(vid, "_c", "_isl").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    still = F.when(F.col(speed) == 0, 1).otherwise(0)
    r = r.withColumn("_z", F.sum(F.when(F.col("_chg") == 0, still).otherwise(0)).over(run))
    s = r.groupBy(vid, "_c").agg(
        F.min_by(pos, time).alias("_first"), F.max_by(pos, time).alias("_last"), F.max("_isl").alias("_runs"),
        F.max(F.when(F.col("_isl") == 1, F.col("_z"))).alias("_z1"), F.max(F.struct("_isl", "_z")).alias("_zn"),
        F.min_by(still, time).alias("_still"))
    hist = Window.partitionBy(vid).orderBy("_c")  # one row per chunk
    s = s.withColumn("_cont", F.coalesce(F.lag("_last").over(hist) == F.col("_first"), F.lit(False)))
    on = F.col("_cont") & (F.col("_runs") == 1)
    s = s.withColumn("_head", F.sum(F.when(on, 0).otherwise(1)).over(hist.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_add", F.when(on, F.col("_still") + F.col("_z1")).otherwise(F.col("_zn._z") + 1))
    s = s.withColumn("_out", F.sum("_add").over(
        Window.partitionBy(vid, "_head").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_in", F.when(F.col("_cont"), F.lag("_out").over(hist) + F.col("_still")))
    r = _with_chunk(r, s.select(vid, "_c", "_in"), vid)
    # the first run of a chunk goes on from the chunk before it, or starts with one
    goes_on = (F.col("_isl") == 1) & F.col("_in").isNotNull()
    r = r.withColumn("_cnt", F.when(goes_on, F.col("_in")).otherwise(F.lit(1)) + F.col("_z"))
    fired = r.filter((F.col(speed) == 0) & (goes_on | (F.col("_chg") == 0)) & (F.col("_cnt") == n))
    return fired.select(*reports.columns)


def stop_intervals(reports: DataFrame, vid: str = "vid", time: str = "r_time",
                   speed: str = "speed", chunk: int = CHUNK) -> DataFrame:
    """Each stop event with the time its vehicle drives on again (``end_time``).

    The end is the vehicle's first later report with non-zero speed (NULL if none): the
    first one in the rest of the stop's chunk, else the first one of a later chunk.
    """
    stops = stop_events(reports, vid=vid, time=time, speed=speed, chunk=chunk) \
        .select(vid, "xway", "seg", "pos", F.col(time).alias("start_time"))
    r, _ = _by_chunk(reports, vid, time, chunk)
    moving = F.when(F.col(speed) != 0, F.col(time))
    # from the end backwards: a growing frame is kept up to date row by row, a shrinking one
    # is recomputed for each row
    back = Window.partitionBy(vid, "_c").orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = r.select(vid, "_c", time, F.min(moving).over(back).alias("_here"))
    later = Window.partitionBy(vid).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = r.groupBy(vid, "_c").agg(F.min(moving).alias("_m")).select(vid, "_c", F.min("_m").over(later).alias("_later"))
    nxt = _with_chunk(here, s, vid).select(vid, F.col(time).alias("start_time"),
                                           F.coalesce("_here", "_later").alias("end_time"))
    return stops.join(nxt, [vid, "start_time"])


def accidents(reports: DataFrame) -> DataFrame:
    """STR-7: two different stopped vehicles at one (xway, pos) at the same time.

    Stop intervals ``[start, drive-on)`` self-joined on ``(xway, pos)`` with overlap and
    ``vid1 < vid2`` (each pair once).  Stops are rare, so the join input is small.
    """
    iv = stop_intervals(reports)
    a, b = iv.alias("a"), iv.alias("b")
    big = F.lit(2**62)
    a_end = F.coalesce(F.col("a.end_time"), big)
    b_end = F.coalesce(F.col("b.end_time"), big)
    j = a.join(b, (F.col("a.xway") == F.col("b.xway")) & (F.col("a.pos") == F.col("b.pos"))
               & (F.col("a.vid") < F.col("b.vid"))
               & (F.col("a.start_time") < b_end) & (F.col("b.start_time") < a_end))
    return j.select(F.col("a.xway").alias("xway"), F.col("a.pos").alias("pos"),
                    F.col("a.seg").alias("seg"),
                    F.col("a.vid").alias("vid1"), F.col("b.vid").alias("vid2"),
                    F.greatest("a.start_time", "b.start_time").alias("start_time"),
                    F.least(F.col("a.end_time"), F.col("b.end_time")).alias("end_time"))
