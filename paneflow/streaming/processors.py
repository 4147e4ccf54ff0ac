"""Keyed stateful stream operators on ``transformWithStateInPandas`` (STR-6 to STR-8, UDF-5, WIN-3).

:class:`InEventTimeOrder` is the base: a key's rows wait in a list state until the watermark
has passed them and then reach :meth:`take` in event-time order, whatever the micro-batches in which
they came.  A timer per key wakes it; the state holds the rows of one watermark delay (and of the
batch at hand), never a key's history.  State lives in Spark's state store (RocksDB provider) and is
checkpointed with the query, so a restarted query goes on with it.

Event times are whole numbers of ``unit_us`` microseconds; a row that is not later than the watermark
of the batch before is dropped by Spark, as in every stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paneflow.operators.stateful import STOP_REPORTS

# The processor runs in Python processes that may not have this package on their path
# (the stream's driver-side runner does not receive ``addPyFile`` files): ship the
# module's code by value with the pickled processor.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to the shipped package
    pass

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InEventTimeOrder(StatefulProcessor):
    """Base class: ``columns`` (name, type) of the rows, the time first; ``out`` the output columns.

    Subclasses add state in :meth:`more_state`, handle one row in :meth:`take` and may report
    what the watermark alone has closed in :meth:`passed`; :meth:`next_time` names the time at
    which that will be."""

    columns: tuple[tuple[str, str], ...] = ()
    out: tuple[str, ...] = ()
    unit_us = 1_000_000                 # the rows' times are seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c for c, _ in self.columns]
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in self.columns))
        self.armed = handle.getValueState("armed", "at long")
        self.more_state(handle)

    def more_state(self, handle: StatefulProcessorHandle) -> None:
        pass

    def take(self, key: tuple, row: tuple) -> Iterable[tuple]:
        """Output rows for one row in event-time order."""
        raise NotImplementedError

    def passed(self, key: tuple, upto: int) -> Iterable[tuple]:
        """Output rows once all rows up to the time ``upto`` have been taken."""
        return ()

    def next_time(self) -> int | None:
        """The time from which :meth:`passed` will have something to say."""
        return None

    def load(self) -> None:
        """Read the state before the first row of a call."""

    def save(self) -> None:
        """Write the state after the last row of a call."""

    def _ms(self, time: int) -> int:
        """The first millisecond at which a time has been reached."""
        return -(-int(time) * self.unit_us // 1000)

    def _arm(self, at: int) -> None:
        now = (self.armed.get() or (None,))[0]
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.armed.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            part = list(zip(*(pdf[c].tolist() for c in self.names), strict=True))
            self.waiting.appendList(part)
            low = min(r[0] for r in part)
            first = low if first is None else min(first, low)
        if first is not None:
            self._arm(self._ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        upto = watermark * 1000 // self.unit_us
        self.armed.clear()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] <= upto), key=self.order)
        later = [r for r in rows if r[0] > upto]
        found: list[tuple] = []
        self.load()
        for row in ready:
            found += self.take(key, row)
        found += self.passed(key, upto)
        self.save()
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        times = [r[0] for r in later] + [t for t in (self.next_time(),) if t is not None]
        if times:
            self._arm(max(self._ms(min(times)), watermark + 1))
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    @staticmethod
    def order(row: tuple):
        """Rows of one time go by the further columns."""
        return row

    def close(self) -> None:
        pass


STOPS = "vid long, xway long, seg long, pos long, start_time long, kind long, r_time long, ts timestamp"
GO, STOP = 0, 1


class StopDetector(InEventTimeOrder):
    """STR-6 per vehicle: the report at which it has been seen ``STOP_REPORTS`` times in a row at
    one position, the later ones with speed 0 (the first report of a run counts whatever its speed),
    as a ``STOP`` row; and for each open stop the first later report with speed, as a ``GO`` row."""

    columns = (("r_time", "long"), ("pos", "long"), ("speed", "long"), ("xway", "long"), ("seg", "long"))
    out = ("vid", "xway", "seg", "pos", "start_time", "kind", "r_time", "ts")

    def more_state(self, handle):
        self.run = handle.getValueState("run", "pos long, n long")
        self.open = handle.getListState("open", "start_time long, xway long, seg long, pos long")

    def load(self):
        self.pos, self.n = self.run.get() or (None, 0)
        self.stops = [tuple(r) for r in self.open.get()]
        self.had_stops = bool(self.stops)

    def save(self):
        if self.pos is not None:
            self.run.update((self.pos, self.n))
        if self.stops:
            self.open.put(self.stops)
        elif self.had_stops:
            self.open.clear()

    def take(self, key, row):
        time, pos, speed, xway, seg = row
        ts = pd.Timestamp(time, unit="s")
        out = []
        if speed != 0:
            out += [(key[0], x, s, p, start, GO, time, ts) for start, x, s, p in self.stops]
            self.stops = []
        if pos != self.pos:
            self.pos, self.n = pos, 1
        elif speed == 0:
            self.n += 1
            if self.n == STOP_REPORTS:
                self.stops.append((time, xway, seg, pos))
                out.append((key[0], xway, seg, pos, time, STOP, time, ts))
        return out


ACCIDENTS = ("xway long, pos long, seg long, vid1 long, vid2 long, start_time long, end_time long, "
             "change long, r_time long, ts timestamp")


class AccidentMap(InEventTimeOrder):
    """STR-7 per (xway, pos): the vehicles that stand there.  A vehicle that stops beside others
    begins an accident with each (``change`` 1, ``end_time`` -1); the first one to drive on
    ends it (``change`` -1).  At one time vehicles leave before others stop."""

    columns = (("r_time", "long"), ("kind", "long"), ("vid", "long"), ("start_time", "long"), ("seg", "long"))
    out = ("xway", "pos", "seg", "vid1", "vid2", "start_time", "end_time", "change", "r_time", "ts")

    def more_state(self, handle):
        self.standing = handle.getMapState("standing", "vid long, start_time long", "seg long")

    def load(self):
        self.others = {tuple(k): v[0] for k, v in self.standing.iterator()} if self.standing.exists() else {}

    def take(self, key, row):
        time, kind, vid, start, seg = row
        if kind == STOP:
            self.others[vid, start] = seg
            self.standing.updateValue((vid, start), (seg,))
        elif self.others.pop((vid, start), None) is not None:
            self.standing.removeKey((vid, start))
        out = []
        for (other, since), other_seg in self.others.items():
            if other != vid:
                end, change = (-1, 1) if kind == STOP else (time, -1)
                at = seg if vid < other else other_seg
                out.append((*key, at, min(vid, other), max(vid, other), max(start, since), end, change, time, pd.Timestamp(time, unit="s")))
        return out


PASSES = "xway long, seg long, pass_time long, reports long, avg_speed double, accident long"


class TollPass(InEventTimeOrder):
    """STR-8 per (xway, seg): every ``period`` seconds of event time in which a report came, the reports
    and their mean speed since the beginning, and whether an accident is open.  The timer is armed
    for the end of the period of the last report and again by the next one."""

    columns = (("r_time", "long"), ("change", "long"), ("speed", "long"))
    out = ("xway", "seg", "pass_time", "reports", "avg_speed", "accident")

    def __init__(self, period: int):
        self.period = period

    def more_state(self, handle):
        self.sums = handle.getValueState("sums", "n long, speed long, open long, due long")

    def load(self):
        self.n, self.speed, self.open_, self.due = self.sums.get() or (0, 0, 0, -1)

    def save(self):
        self.sums.update((self.n, self.speed, self.open_, self.due))

    def _pass(self, key):
        out = [(*key, self.due, self.n, self.speed / self.n, int(self.open_ > 0))]
        self.due = -1
        return out

    def take(self, key, row):
        time, change, speed = row
        out = self._pass(key) if 0 <= self.due <= time else []
        if change == 0:
            self.n, self.speed = self.n + 1, self.speed + speed
            self.due = (time // self.period + 1) * self.period
        else:
            self.open_ += change
        return out

    def passed(self, key, upto):
        return self._pass(key) if 0 <= self.due <= upto else []

    def next_time(self):
        return self.due if self.due >= 0 else None


class RowWindows(InEventTimeOrder):
    """WIN-3 per key: windows of ``size`` rows, a new one every ``slide`` rows, in arrival order by
    event time; the state is the arrivals' number and the last ``size`` values.  A window leaves
    when its last row has come."""

    unit_us = 1
    columns = (("t", "long"), ("v", "long"))

    def __init__(self, size: int, slide: int, key: str):
        self.size, self.slide = size, slide
        self.out = (key, "win_id", "cnt", "sum_v", "first_idx")

    def more_state(self, handle):
        self.arrived = handle.getValueState("arrived", "n long")
        self.ring = handle.getListState("ring", "v long")

    def load(self):
        self.n = (self.arrived.get() or (0,))[0]
        self.last = [r[0] for r in self.ring.get()]

    def save(self):
        if self.n:
            self.arrived.update((self.n,))
            self.last = self.last[-self.size:]
            self.ring.put([(v,) for v in self.last])

    def take(self, key, row):
        self.n += 1
        self.last.append(row[1])
        first = self.n - self.size
        if first < 0 or first % self.slide:
            return ()
        if len(self.last) > 4 * self.size:
            self.last = self.last[-self.size:]
        return [(key[0], first // self.slide, self.size, sum(self.last[-self.size:]), first)]


class RowJoin(InEventTimeOrder):
    """JN-2 per key: an arriving row meets the last ``size`` rows of the other side that came before
    it, if the left value is smaller; at one time right rows (side 0) come first."""

    unit_us = 1
    columns = (("t", "long"), ("side", "long"), ("id", "long"), ("value", "double"))

    def __init__(self, size: int, key: str):
        self.size = size
        self.out = (key, "l_id", "r_id")

    def more_state(self, handle):
        self.rings = [handle.getListState(f"ring{k}", "id long, value double") for k in range(2)]

    def load(self):
        self.last = [[tuple(r) for r in ring.get()] for ring in self.rings]

    def save(self):
        for ring, last in zip(self.rings, self.last, strict=True):
            if last:
                ring.put(last)

    def take(self, key, row):
        _, side, id_, value = row
        if side:
            out = [(key[0], id_, other) for other, v in self.last[0] if value < v]
        else:
            out = [(key[0], other, id_) for other, v in self.last[1] if v < value]
        self.last[side] = [*self.last[side], (id_, value)][-self.size:]
        return out


def row_windows_stream(rows: DataFrame, key: str, value: str, size: int, slide: int) -> DataFrame:
    """WIN-3: (key, win_id, cnt, sum_v, first_idx) of the full row windows of a watermarked stream."""
    src = rows.where(F.col("ts").isNotNull()).select(key, F.unix_micros("ts").alias("t"), F.col(value).cast("long").alias("v"), "ts")
    kind = rows.schema[key].dataType.simpleString()
    return ordered(src, [key], RowWindows(size, slide, key), f"{key} {kind}, win_id long, cnt long, sum_v long, first_idx long")


def row_join_stream(rows: DataFrame, key: str, side: str, id_: str, value: str, size: int) -> DataFrame:
    """JN-2: (key, l_id, r_id) of a watermarked stream whose column ``side`` is 1 for left rows."""
    src = rows.where(F.col("ts").isNotNull()).select(key, F.unix_micros("ts").alias("t"), F.col(side).cast("long").alias("side"),
                                                     F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value"), "ts")
    kind = rows.schema[key].dataType.simpleString()
    return ordered(src, [key], RowJoin(size, key), f"{key} {kind}, l_id long, r_id long")


def ordered(stream: DataFrame, keys: list[str], processor: InEventTimeOrder, schema: str, event_time: str = "") -> DataFrame:
    """Apply a processor per key in append mode; ``event_time`` names the output's time for the next
    stateful operator of the query."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName=event_time)


def _timed(reports: DataFrame) -> DataFrame:
    """Reports with the seconds of their event time; those without a time belong to no order."""
    return reports.where(F.col("ts").isNotNull()).withColumn("r_time", F.unix_seconds("ts"))


def stop_changes(reports: DataFrame) -> DataFrame:
    """Stops and drive-ons of all vehicles (:data:`STOPS`) of watermarked reports."""
    rows = _timed(reports).select("vid", "xway", "seg", "pos", "r_time", "speed", "ts")
    return ordered(rows, ["vid"], StopDetector(), STOPS, "ts")


def stop_detector_stream(reports: DataFrame) -> DataFrame:
    """STR-6: the stop events (vid, xway, seg, pos, r_time)."""
    return stop_changes(reports).where(F.col("kind") == STOP).select("vid", "xway", "seg", "pos", "r_time")


def accident_changes(reports: DataFrame) -> DataFrame:
    """Begins and ends of accidents (:data:`ACCIDENTS`): the map of standing vehicles fed by the detector."""
    return ordered(stop_changes(reports), ["xway", "pos"], AccidentMap(), ACCIDENTS, "ts")


def toll_pass_stream(reports: DataFrame, period: int) -> DataFrame:
    """STR-8: passes (:data:`PASSES`) over the reports and the accident changes of each segment."""
    changes = accident_changes(reports).select("xway", "seg", "r_time", "change", F.lit(0).cast("long").alias("speed"), "ts")
    rows = _timed(reports).select("xway", "seg", "r_time", F.lit(0).cast("long").alias("change"), "speed", "ts")
    return ordered(rows.unionByName(changes), ["xway", "seg"], TollPass(period), PASSES)
