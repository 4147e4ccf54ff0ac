"""Aggregations (AGG-1 … AGG-25) and top-k (TOP-1, TOP-2).

All aggregates are Spark's partial/final hash aggregates (map-side combine, then one
shuffle on the grouping keys).  Three operators go beyond a plain ``groupBy``:

* :func:`pane_sliding` — sliding windows evaluated over panes of ``gcd(size, slide)``:
  rows are aggregated once per pane and only the (much smaller) pane results are
  replicated ``size/slide`` times, instead of every input row.
* :func:`quantiles` — exact interpolated quantiles with position ``p(n+1)/100``,
  computed from a distributed per-group rank (no group is ever collected).
* :func:`combine_aggregate` — user aggregate given as init / add / merge / result,
  run as per-partition partial states (``mapInPandas``) merged after the shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.operators import windows as W

# Aggregation names understood by :func:`parse_aggs` (fixed names of the reference API).
AGG_NAMES = ("MAX", "MIN", "CNT", "SUM", "AVG")


def agg_type(name: str) -> str:
    """Aggregation type of a name such as ``cnt``, ``AVG`` or ``sum(value)``."""
    token = re.split(r"[^A-Za-z]+", name.strip(), maxsplit=1)[0].upper()
    if token not in AGG_NAMES:
        raise ValueError(f"unknown aggregation type: {name!r}")
    return token.lower()


def agg_column(kind: str, value: str | Column | None, alias: str | None = None) -> Column:
    kind = agg_type(kind)
    v = W.col_of(value) if value is not None else None
    fn = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg}.get(kind)
    c = F.count(F.lit(1)) if kind == "cnt" else fn(v)
    return c.alias(alias) if alias else c


def parse_aggs(spec: str, value: str) -> list[Column]:
    """AGG-1: ``"cnt,avg,min"`` → aggregate columns over ``value`` named like ``avg_value``."""
    out = []
    for part in spec.split(","):
        part = part.strip()
        if part:
            k = agg_type(part)
            out.append(agg_column(k, value, f"{k}_{value}" if k != "cnt" else "cnt"))
    return out


def window_aggregate(df: DataFrame, window_col: str, keys: Sequence[str],
                     aggs: Sequence[Column]) -> DataFrame:
    """AGG-2 / AGG-3 / AGG-4: group by window (+ keys) and aggregate in one pass.

    Output: ``window_start``, ``window_end`` (epoch µs), keys, aggregates.
    """
    g = df.groupBy(window_col, *keys).agg(*aggs)
    return g.select(*W.bounds(window_col), *keys, *[c for c in g.columns
                                                   if c not in (window_col, *keys)])


# ---------------------------------------------------------------- pane rewrite

DECOMPOSABLE = ("cnt", "sum", "min", "max", "avg")


def pane_sliding(df: DataFrame, size, slide, aggs: dict[str, tuple[str, str | None]],
                 keys: Sequence[str] = (), ts: str = "ts", stream_start=None) -> DataFrame:
    """AGG-5 / WIN-6: sliding-window aggregate computed from panes.

    ``aggs`` maps output name → (kind, value column).  Pane = gcd(size, slide).
    Step 1 aggregates rows into panes (map-side partial aggregation, one shuffle on
    ``(pane, keys)``); step 2 assigns each *pane* to its ``size/slide`` windows and
    combines the pane partials (sum of sums / counts, min of mins, max of maxes,
    avg = total / count).  Same result as ``groupBy(window(ts, size, slide))``.
    """
    s, d = W.to_us(size), W.to_us(slide)
    pane = math.gcd(s, d)
    partial = []
    for name, (kind, value) in aggs.items():
        kind = agg_type(kind)
        if kind not in DECOMPOSABLE:
            raise ValueError(kind)
        if kind in ("cnt", "avg"):
            partial.append(F.count(F.lit(1) if value is None else F.col(value)).alias(f"_c_{name}"))
        if kind in ("sum", "avg"):
            partial.append(F.sum(value).alias(f"_s_{name}"))
        if kind in ("min", "max"):
            partial.append(agg_column(kind, value, f"_{kind}_{name}"))
    panes = df.groupBy(F.window(ts, f"{pane} microseconds").alias("_pane"), *keys).agg(*partial)
    # window_time keeps the watermark, so the second window works on a stream too
    win = F.window(F.window_time("_pane"), f"{s} microseconds", f"{d} microseconds")
    windowed = panes.withColumn("window", win)
    if stream_start is not None:
        windowed = windowed.filter(F.col("window.start") >= F.lit(stream_start).cast("timestamp"))
    final = []
    for name, (kind, value) in aggs.items():
        kind = agg_type(kind)
        if kind == "cnt":
            final.append(F.sum(f"_c_{name}").alias(name))
        elif kind == "sum":
            final.append(F.sum(f"_s_{name}").alias(name))
        elif kind == "avg":
            final.append((F.sum(f"_s_{name}") / F.sum(f"_c_{name}")).alias(name))
        else:
            final.append(agg_column(kind, f"_{kind}_{name}", name))
    return window_aggregate(windowed, "window", keys, final)


# ---------------------------------------------------------------- quantiles

def quantiles(df: DataFrame, value: str, keys: Sequence[str] = (),
              percents: Iterable[float] = (5, 25, 50, 75, 99)) -> DataFrame:
    """AGG-22: exact quantiles at position ``p(n+1)/100`` with linear interpolation.

    Position below 1 → minimum; at or above n → maximum.  (Spark's ``percentile`` uses
    ``(n-1)p`` and buffers every value of a group, so it is neither the same
    definition nor scalable.)  The per-group rank comes from
    :func:`paneflow.operators.windows.row_index`, which range-partitions on
    ``(keys, value)``; only the ≤ 2·len(percents) ranks needed per group are
    joined back.  Output: keys, ``p``, ``quantile``, plus ``n``/``min``/``max``/``avg``.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        base = base.withColumn("_g", F.lit(0))
        gk = ["_g"]
    else:
        gk = keys
    stats = base.groupBy(*gk).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"),
                                  F.max("_v").alias("max"), F.avg("_v").alias("avg"))
    # ranks needed per (group, p): the fixed percent list is exploded on the
    # (small) per-group statistics, len(percents) rows per group.
    plist = F.array(*[F.lit(float(p)) for p in percents])
    pos = F.col("p") * (F.col("n") + 1) / F.lit(100.0)
    fpos = F.floor(pos).cast("long")
    tgt = stats.withColumn("p", F.explode(plist)) \
        .withColumn("_pos", pos) \
        .withColumn("_lo", F.when(pos < 1, 0).when(pos >= F.col("n"), F.col("n") - 1)
                    .otherwise(fpos - 1)) \
        .withColumn("_hi", F.when(pos < 1, 0).when(pos >= F.col("n"), F.col("n") - 1)
                    .otherwise(fpos)) \
        .withColumn("_dif", F.when((pos < 1) | (pos >= F.col("n")), F.lit(0.0))
                    .otherwise(pos - fpos))
    ranked = W.row_index(base, ["_v"], gk, out="_r")
    need = tgt.select(*gk, F.col("_lo").alias("_r")).union(tgt.select(*gk, F.col("_hi").alias("_r"))) \
              .distinct()
    vals = ranked.join(need, [*gk, "_r"], "left_semi").select(*gk, "_r", "_v")
    lo = vals.withColumnRenamed("_r", "_lo").withColumnRenamed("_v", "_lov")
    hi = vals.withColumnRenamed("_r", "_hi").withColumnRenamed("_v", "_hiv")
    out = tgt.join(lo, [*gk, "_lo"]).join(hi, [*gk, "_hi"])
    q = (F.col("_lov") + F.col("_dif") * (F.col("_hiv") - F.col("_lov"))).alias("quantile")
    return out.select(*keys, "p", q, "n", "min", "max", "avg")


# ---------------------------------------------------------------- top-k

def top_k(df: DataFrame, k: int, partition: Sequence[str], value: str,
          tie: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """TOP-1: the ``k`` rows with the largest ``value`` per partition group.

    Ties are broken by ``tie`` ascending (deterministic).  Spark plans the filter on
    ``row_number`` as a WindowGroupLimit that also runs *before* the shuffle, so each
    map task forwards at most ``k`` rows per group.
    """
    w = Window.partitionBy(*partition).orderBy(F.col(value).desc(), *[F.col(t).asc() for t in tie])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


# ---------------------------------------------------------------- user aggregate

#: Keys a task holds partial states of before it sends them on.
MAX_STATES = 100_000


def combine_aggregate(df: DataFrame, keys: Sequence[str], value: str,
                      init: Callable[[], float],
                      add: Callable[[float, "object"], float],
                      merge: Callable[[float, float], float],
                      result: Callable[[float], float] = lambda s: s,
                      out: str = "agg") -> DataFrame:
    """AGG-24 / UDF-3 / UDF-9: user aggregate (init / add / merge / result).

    Phase 1 (``mapInArrow``, no shuffle): every partition folds its rows per key with
    ``add(state, values: pandas.Series)`` → one partial state per key and partition.
    Phase 2: partial states are shuffled on the keys and merged with ``merge`` in a
    grouped ``applyInPandas``; a group there holds one state per map partition
    (bounded by the partition count), never the raw rows of a hot key.
    States are doubles.
    """
    import pandas as pd
    import pyarrow as pa

    keys = list(keys)
    schema_keys = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    part_schema = f"{schema_keys}, _state double" if keys else "_state double"

    def rows_of(acc, types):
        cols = list(zip(*acc, strict=True)) if acc else [()] * len(keys)
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([float(x) for x in acc.values()], pa.float64())], names=[*keys, "_state"])

    def partial(batches):
        acc: dict = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            # integers with nulls as objects: a NULL key keeps its group, a long its digits
            pdf = batch.to_pandas(integer_object_nulls=True)
            if keys:
                k = pdf[keys].astype(object)
                raw = k.to_numpy()
                for at in k.groupby(keys, sort=False, dropna=False).indices.values():
                    # the first row's values: the group's own label would turn longs to doubles
                    name = tuple(None if pd.isna(x) else x for x in raw[at[0]])
                    acc[name] = add(acc.get(name, init()), pdf[value].iloc[at])
                if len(acc) > MAX_STATES:  # a partial state may be sent more than once
                    yield rows_of(acc, types)
                    acc = {}
            else:
                acc[()] = add(acc.get((), init()), pdf[value])
        if types is not None:
            yield rows_of(acc, types)

    parts = df.select(*keys, value).mapInArrow(partial, part_schema)

    def final(pdf):
        st = init()
        for s in pdf["_state"]:
            st = merge(st, s)
        row = {k: pd.Series([None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0]], dtype=object) for k in keys}
        row[out] = [float(result(st))]
        return pd.DataFrame(row)

    out_schema = f"{schema_keys}, `{out}` double" if keys else f"`{out}` double"
    if keys:
        return parts.groupBy(*keys).applyInPandas(final, out_schema)
    return parts.groupBy().applyInPandas(final, out_schema)
