"""Joins (JN-1 … JN-11).

* Static-side joins broadcast only behind a size check (:func:`checked_broadcast`):
  the dimension is counted with a cap; above the cap the join is left to the
  shuffle join that Catalyst/AQE choose.
* Time-range joins never run as a nested loop or as an equi-join whose key
  groups hold a whole hot key: an equi **time-bucket** key is added (bucket width
  = the window span, a quarter of it for theta joins, the probing side replicated to
  the buckets its range touches) and the exact range predicate is kept as a join
  condition.  Work per bucket is bounded by the rows inside one window span, and a Spark
  stream-stream join accepts the form because it has an equality.
* Row-count-window joins (JN-2) turn arrival order into indices with
  :func:`paneflow.operators.windows.row_index` and then reuse the bucketed range
  join on indices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.operators import windows as W

DEFAULT_BROADCAST_ROWS = 1_000_000


def checked_broadcast(dim: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``dim`` only if it provably has at most ``max_rows`` rows.

    The check is ``limit(max_rows + 1).count()`` — a job that stops reading after
    ``max_rows + 1`` rows.  Streaming frames and larger sides are returned unhinted,
    so the planner keeps a shuffle join (AQE may still switch to broadcast on the
    measured size).
    """
    if dim.isStreaming:
        return dim
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def stream_static_join(stream: DataFrame, dim: DataFrame, on: str | Sequence[str],
                       max_dim_rows: int = DEFAULT_BROADCAST_ROWS,
                       dim_bounded: bool = False) -> DataFrame:
    """JN-5 / JN-6: inner join of a (stream or batch) fact with a static dimension.

    Misses are dropped (inner).  ``dim_bounded=True`` states that the dimension has a
    size bound by construction (e.g. keys taken modulo a constant), which skips the
    counting job.
    """
    side = F.broadcast(dim) if dim_bounded else checked_broadcast(dim, max_dim_rows)
    return stream.join(side, on, "inner")


def _bucket(ts_us: Column, width: int) -> Column:
    return F.floor(ts_us / F.lit(width)).cast("long")


#: Time buckets per window span: a left row meets the right rows of 1 + 1 / BUCKETS spans.
BUCKETS = 4
#: Tasks per core of a join without keys.  Its work is the pairs, which the bytes of its sides say
#: nothing about, so the partitions are fixed and AQE does not coalesce them.
TASKS_PER_CORE = 8
#: Rows of a side in one cell of a join without keys, and right rows that a left row meets at once.
CELL_ROWS = 50_000
BLOCK_ROWS = 256


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism * TASKS_PER_CORE, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _grids(L: DataFrame, R: DataFrame) -> dict[int, tuple[int, int]]:
    """Busy time bucket -> (left parts, right parts) of its pairs.

    A bucket is busy if it has more than its share of all pairs (half a task's, so there are fewer than two a
    task) or more than ``CELL_ROWS`` rows of a side.  The pairs are cut into a grid of cells; its sides follow the
    numbers of rows, which keeps the copies of the rows few.
    """
    sizes = [df.groupBy("_b").agg(F.count(F.lit(1)).alias(n)) for df, n in ((L, "l"), (R, "r"))]
    both = sizes[0].join(sizes[1], "_b").withColumn("pairs", F.col("l").cast("double") * F.col("r"))
    both = both.crossJoin(F.broadcast(both.agg((F.sum("pairs") / (2 * _tasks(L))).alias("share"))))
    grids = {}
    for x in both.where((F.col("pairs") > F.col("share")) | (F.greatest("l", "r") > CELL_ROWS)).collect():
        cells = math.ceil(x["pairs"] / x["share"])
        lefts = max(math.ceil(x["l"] / CELL_ROWS), min(x["l"], math.ceil(math.sqrt(cells * x["l"] / x["r"]))))
        grids[x["_b"]] = (lefts, max(math.ceil(x["r"] / CELL_ROWS), min(x["r"], math.ceil(cells / lefts))))
    return grids


def _celled(df: DataFrame, grids: dict[int, tuple[int, int]], own: Sequence[str], right: bool) -> DataFrame:
    """Rows with their cells ``_c``: one part of their own side (by a hash of the row), all parts of the other."""
    busy = df.sparkSession.createDataFrame([(b, *x) for b, x in grids.items()], "_g long, _lefts int, _rights int")
    parts, others = (F.coalesce(F.col(c), F.lit(1)) for c in (("_rights", "_lefts") if right else ("_lefts", "_rights")))
    mine, k = F.pmod(F.xxhash64(*own), parts), F.explode(F.sequence(F.lit(0), others - 1))
    df = df.join(F.broadcast(busy), F.col("_b") == F.col("_g"), "left").withColumns({"_mine": mine, "_rights": F.coalesce("_rights", F.lit(1))}).withColumn("_k", k)
    cell = F.col("_k") * F.col("_rights") + F.col("_mine") if right else F.col("_mine") * F.col("_rights") + F.col("_k")
    return df.withColumn("_c", cell.cast("int")).drop("_g", "_lefts", "_rights", "_mine", "_k")


def _blocks(R: DataFrame, keys: Sequence[str], other: Sequence[str], order: str | None, levels: int) -> DataFrame:
    """The right rows of a cell in blocks of neighbours in ``order``, an array per column, with the ends of their times
    and the greatest ``order``: 2**levels blocks a cell at least, of ``BLOCK_ROWS`` rows at most."""
    cell, by = Window.partitionBy(*keys), F.col(order or "_at")
    n = F.least(F.lit(BLOCK_ROWS), F.ceil(F.count(F.lit(1)).over(cell) / F.lit(2**levels)))
    R = R.withColumn("_block", F.floor((F.row_number().over(cell.orderBy(by.desc())) - 1) / n))
    R = R.groupBy(*keys, "_block").agg(F.collect_list(F.struct(*other, "_at")).alias("_rows"), F.min("_at").alias("_first"),
                                       F.max("_at").alias("_last"), F.max(by).alias("_top"))
    return R.select(*keys, "_first", "_last", "_top", *(F.col(f"_rows.{c}").alias(c) for c in (*other, "_at")))


def _block_join(L: DataFrame, R: DataFrame, own: Sequence[str], other: Sequence[str], lo: int, hi: int, order: str | None, levels: int,
                reach: Column | None) -> DataFrame:
    """All pairs with ``_at`` of the right row in ``[_at - lo, _at + hi]`` of the left one.

    The buckets, or cells of a busy bucket, are dealt to ``TASKS_PER_CORE`` tasks a core.  Only after that do the
    right rows come together in blocks and a left row gets its range, so rows travel narrow and once per bucket.
    A left row skips the blocks that lie out of its range, or whose greatest ``order`` is not above ``reach``.
    """
    keys, grids = ["_b"], _grids(L, R)
    if grids:
        keys = ["_b", "_c"]
        L, R = _celled(L, grids, own, False), _celled(R, grids, other, True)
    n = _tasks(L)
    L = L.repartition(n, *keys).withColumns({"_from": F.col("_at") - F.lit(lo), "_to": F.col("_at") + F.lit(hi)}).drop("_at")
    R = _blocks(R.repartition(n, *keys), keys, other, order, levels)
    l_, r_ = L.alias("_l").hint("merge"), R.alias("_r")
    cond = (F.col("_last") >= F.col("_from")) & (F.col("_first") <= F.col("_to"))
    for k in keys:
        cond = cond & (F.col(f"_l.{k}") == F.col(f"_r.{k}"))
    j = l_.join(r_, cond if reach is None else cond & (reach < F.col("_top")), "inner")
    j = j.select(*own, *other, "_from", "_to", F.posexplode("_at").alias("_k", "_at"))
    return j.where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))).select(*own, *(F.get(c, F.col("_k")).alias(c) for c in other))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  lower, upper, lts: str = "ts", rts: str = "ts",
                  lower_inclusive: bool = True, upper_inclusive: bool = False,
                  condition: Callable[[DataFrame, DataFrame], Column] | None = None,
                  lprefix: str = "l_", rprefix: str = "r_", splits: int = 8,
                  order: str | None = None, levels: int = 0, reach: Column | None = None) -> DataFrame:
    """JN-1 / JN-7: inner join with ``r.ts`` in ``[l.ts - lower, l.ts + upper)``.

    Bounds inclusive/exclusive as flagged (default ``[ , )``).  ``keys`` may be empty
    (pure theta join on time + ``condition``).  Columns of the two sides are
    prefixed (``l_`` / ``r_``); join keys appear once, unprefixed.
    Works on batch and on streaming frames (with watermarks on both sides).

    Without keys the time bucket is the only hash key.  In a batch a span is then cut into
    ``BUCKETS`` of them, the pairs of a busy bucket into cells, and the right rows of a cell into
    blocks (:func:`_block_join`).  ``order`` names the right column whose neighbours share a block;
    ``reach`` is a number of the left row that ``order`` must exceed.  In a stream a bucket
    is cut into ``splits`` parts by a hash of the left row (the right rows go to all of them).

    A batch compares times as microseconds; a stream compares the timestamps, since it finds
    the end of its state in that condition.
    """
    lo_us, hi_us = W.to_us(lower) if lower else 0, W.to_us(upper) if upper else 0
    keys = list(keys)
    stream = left.isStreaming or right.isStreaming
    blocks = not keys and not stream
    width = max((lo_us + hi_us) // (BUCKETS if blocks else 1), 1)
    lcols = [F.col(c).alias(c if c in keys else lprefix + c) for c in left.columns]
    rcols = [F.col(c).alias(c if c in keys else rprefix + c) for c in right.columns]
    L = left.select(*lcols)
    R = right.select(*rcols)
    lt, rt = F.col(lprefix + lts), F.col(rprefix + rts)
    lt_us = W.micros(lt)
    own = [c for c in L.columns if c not in keys]
    other = [c for c in R.columns if c not in keys]
    # the ends of a pair's range as closed bounds
    lo_at, hi_at = lo_us - (not lower_inclusive), hi_us - (not upper_inclusive)
    if not stream:
        R = R.withColumn("_at", W.micros(rt))
    # right row: its own bucket; left row: every bucket its range touches
    R = R.withColumn("_b", _bucket(W.micros(rt), width))
    buckets = F.explode(F.sequence(_bucket(lt_us - F.lit(lo_us), width), _bucket(lt_us + F.lit(hi_us), width)))
    if blocks:
        L, R = L.withColumn("_at", lt_us).withColumn("_b", buckets), R.where(F.col("_b").isNotNull())
        j = _block_join(L, R, own, other, lo_at, hi_at, order and rprefix + order, levels, reach)
        return (j.where(condition(j, j)) if condition else j).select(*own, *other)
    if not stream:
        # taken once per row: a pair costs two comparisons
        L = L.withColumn("_from", lt_us - F.lit(lo_at)).withColumn("_to", lt_us + F.lit(hi_at))
    L = L.withColumn("_b", buckets)
    hashed = ["_b"]
    if not keys and splits > 1:
        L = L.withColumn("_s", F.pmod(F.xxhash64(*own), F.lit(splits)).cast("int"))
        R = R.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        hashed.append("_s")
    if stream:
        lo_t = lt - F.expr(f"INTERVAL {lo_us} MICROSECONDS")
        hi_t = lt + F.expr(f"INTERVAL {hi_us} MICROSECONDS")
        cond = (rt >= lo_t) if lower_inclusive else (rt > lo_t)
        cond = cond & ((rt <= hi_t) if upper_inclusive else (rt < hi_t))
    else:
        cond = (F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))
    l_, r_ = L.alias("_l"), R.alias("_r")
    eq = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in keys + hashed]
    full = eq[0]
    for e in eq[1:]:
        full = full & e
    # prefixed columns are unique, so the range condition needs no qualification
    extra = condition(L, R) if condition else F.lit(True)
    j = l_.join(r_, full & cond & extra, "inner")
    out = [F.col(f"_l.{k}").alias(k) for k in keys]
    out += [F.col(f"_l.{c}") for c in own]
    out += [F.col(f"_r.{c}") for c in other]
    return j.select(*out)


def theta_join_range(left: DataFrame, right: DataFrame, size_left, size_right,
                     predicate: Callable[[Column, Column], Column] | None = None,
                     ts: str = "ts", lprefix: str = "l_", rprefix: str = "r_", order: str | None = None) -> DataFrame:
    """JN-1 / JN-3 / JN-4: windowed theta join over range windows.

    A pair matches when the later tuple arrives while the earlier one is still in its
    side's window: ``r.ts ∈ [l.ts - size_right, l.ts + size_left]`` (both bounds
    inclusive) and ``predicate(l, r)``.  ``predicate`` receives column resolvers for
    the prefixed sides, e.g. ``lambda l, r: l("value") < r("value")``.  ``order`` names the right
    column by which a left row's pairs follow each other; it decides only how well they compress.
    """
    def lc(name):
        return F.col(lprefix + name)

    def rc(name):
        return F.col(rprefix + name)

    cond = (lambda L, R: predicate(lc, rc)) if predicate else None
    return interval_join(left, right, [], size_right, size_left, lts=ts, rts=ts,
                         lower_inclusive=True, upper_inclusive=True, condition=cond,
                         lprefix=lprefix, rprefix=rprefix, order=order)


def theta_join_less(left: DataFrame, right: DataFrame, size_left, size_right, value: str, offset: float = 0.0,
                    levels: int = 6, ts: str = "ts", lprefix: str = "l_", rprefix: str = "r_") -> DataFrame:
    """JN-3: the windowed theta join with ``l.value + offset < r.value``; ``offset`` chooses the
    selectivity.

    The right rows of a cell are laid out by falling value and cut into blocks, ``2**levels`` of them at
    least.  A left row meets the blocks whose greatest value is above its own; in all of them but one
    every value is, so the candidates are the results and 1 / 2**levels of the rest.  Both
    sides travel as in any join without keys.  Rows without a value match nothing.
    """
    reach = F.col(lprefix + value) + F.lit(float(offset))
    L, R = (df.where(F.col(value).isNotNull()) for df in (left, right))
    return interval_join(L, R, [], size_right, size_left, lts=ts, rts=ts, lower_inclusive=True, upper_inclusive=True, order=value, levels=levels, reach=reach,
                         condition=lambda a, b: reach < F.col(rprefix + value), lprefix=lprefix, rprefix=rprefix)


def _window_start(count: Column, size: int, slide: int) -> Column:
    """Row window start after ``count`` arrivals: advances by ``slide`` on overflow."""
    over = count - F.lit(size)
    return F.when(over <= 0, F.lit(0)).otherwise(
        F.ceil(over / F.lit(float(slide))).cast("long") * F.lit(slide))


def theta_join_rows(left: DataFrame, right: DataFrame, size_left: int, size_right: int,
                    slide_left: int = 1, slide_right: int = 1,
                    predicate: Callable[[Column, Column], Column] | None = None,
                    ts: str = "ts", order: Sequence[str] = (),
                    lprefix: str = "l_", rprefix: str = "r_") -> DataFrame:
    """JN-2: windowed theta join over row-count windows (batch).

    Arrival order = ``(ts, side, order…)`` with the right side first on equal
    timestamps.  A tuple arriving after ``c`` tuples of the other side is matched
    against that side's window ``[start(c), c)``, where the start advances by
    ``slide`` whenever the window would exceed ``size`` rows.  Indices come from a
    distributed :func:`row_index`; the index range join is bucketed like
    :func:`interval_join` (bucket width = window size).
    """
    order = list(order)
    lt = left.select(ts, *order, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rt = right.select(ts, *order, F.lit(0).alias("_side"), F.struct(*right.columns).alias("_row"))
    # one indexing pass: merged arrival index and the number of left tuples before
    merged = W.row_index(lt.unionByName(rt), [ts, "_side", *order], out="_m",
                         counts_before={"_lb": F.col("_side") == 1})
    # _j: index among its own side; _other: tuples of the other side that came before
    L = merged.filter(F.col("_side") == 1) \
        .withColumn("_j", F.col("_lb")).withColumn("_other", F.col("_m") - F.col("_lb"))
    R = merged.filter(F.col("_side") == 0) \
        .withColumn("_j", F.col("_m") - F.col("_lb")).withColumn("_other", F.col("_lb"))

    def probe(a: DataFrame, b: DataFrame, size: int, slide: int) -> DataFrame:
        """Rows of ``a`` matched to the window over ``b`` (indices ``_j`` of b)."""
        lo = _window_start(F.col("_other"), size, slide)
        hi = F.col("_other")  # exclusive
        a2 = a.select(F.col("_row").alias("_a"), lo.alias("_lo"), hi.alias("_hi")) \
              .filter(F.col("_hi") > F.col("_lo")) \
              .withColumn("_b", F.explode(F.sequence(
                  F.floor(F.col("_lo") / F.lit(size)).cast("long"),
                  F.floor((F.col("_hi") - 1) / F.lit(size)).cast("long"))))
        b2 = b.select(F.col("_row").alias("_o"), F.col("_j"),
                      F.floor(F.col("_j") / F.lit(size)).cast("long").alias("_b"))
        return a2.join(b2, "_b").filter((F.col("_j") >= F.col("_lo")) & (F.col("_j") < F.col("_hi")))

    # left arrivals probe the right window; right arrivals probe the left window
    p1 = probe(L, R, size_right, slide_right).select(F.col("_a").alias("_l"), F.col("_o").alias("_r"))
    p2 = probe(R, L, size_left, slide_left).select(F.col("_o").alias("_l"), F.col("_a").alias("_r"))
    pairs = p1.unionByName(p2)
    out = pairs.select(*[F.col(f"_l.{c}").alias(lprefix + c) for c in left.columns],
                       *[F.col(f"_r.{c}").alias(rprefix + c) for c in right.columns])
    if predicate:
        out = out.filter(predicate(lambda n: F.col(lprefix + n), lambda n: F.col(rprefix + n)))
    return out


def window_equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     how: str = "inner") -> DataFrame:
    """JN-9 / JN-11: join two windowed results on (keys, window bounds)."""
    return left.join(right, list(keys), how)


def cogroup_exists(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   flag: str = "has_right") -> DataFrame:
    """JN-10: windowed cogroup emitting every left row with whether the right group is empty.

    The right side is reduced to one row per key (``exists``) before the join, so the
    join never multiplies left rows; keys with only right rows emit nothing.
    """
    keys = list(keys)
    r = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(r, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def cogroup_apply(left: DataFrame, right: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """UDF-6: a user function over the cogroup of two frames.

    ``fn(left rows, right rows) -> rows`` (pandas frames, one of them empty where a side lacks the key) sees
    all rows of a key at once, so give it sides that are aggregated to a bounded number of rows per key.
    """
    l_, r_ = left.toDF(*left.columns), right.toDF(*right.columns)   # fresh columns: the sides may share a source
    return l_.groupBy(*keys).cogroup(r_.groupBy(*keys)).applyInPandas(fn, schema)
