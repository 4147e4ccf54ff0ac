"""Rate-controlled event-time assignment (SRC-14) and literal in-memory sources.

A replaying source gives every record of a bundle the same timestamp and may add a
gap after each epoch (to force session boundaries):

    ts = base + floor(row / bundle) * delta + floor(row / epoch) * gap

``row`` is a dense record number.  When the table already has one (``doc_id``,
``event_id`` …) it is used directly — a projection, no shuffle; otherwise it comes
from the distributed :func:`paneflow.operators.windows.row_index`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.operators import windows as W

DEFAULT_BASE = "2024-01-01 00:00:00"


def assign_event_time(df: DataFrame, row: str | None = None, order: list[str] | None = None,
                      bundle: int = 1, delta="1 second", epoch: int | None = None,
                      gap=None, base: str = DEFAULT_BASE, out: str = "ts") -> DataFrame:
    """Add ``out`` = event time of each record per the bundle/epoch rule."""
    if row is None:
        df = W.row_index(df, order or df.columns[:1], out="_row")
        row = "_row"
    r = F.col(row).cast("long")
    us = F.floor(r / F.lit(bundle)).cast("long") * F.lit(W.to_us(delta))
    if epoch and gap:
        us = us + F.floor(r / F.lit(epoch)).cast("long") * F.lit(W.to_us(gap))
    ts = F.timestamp_micros(W.micros(F.lit(base).cast("timestamp")) + us)
    out_df = df.withColumn(out, ts)
    return out_df.drop("_row") if row == "_row" else out_df
