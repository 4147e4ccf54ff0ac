"""Projection, mapping and element-wise user code (PRJ-1 … PRJ-7, UDF-1, UDF-2, UDF-7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *exprs: Column | str) -> DataFrame:
    """PRJ-1: projection of an expression list."""
    return df.select(*exprs)


def pass_through(df: DataFrame) -> DataFrame:
    """PRJ-3: no-op operator."""
    return df.select("*")


def update_columns(df: DataFrame, updates: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """PRJ-7: per-column update with row drop (``withColumns`` + ``filter``)."""
    r = df.withColumns(updates)
    return r.filter(keep) if keep is not None else r


def par_do(df: DataFrame, fn: Callable[["object"], "object"], schema: str, rows: int | None = None) -> DataFrame:
    """PRJ-6 / UDF-2: element-wise user code on Arrow batches (``mapInPandas``).

    ``fn(pandas.DataFrame) -> pandas.DataFrame`` may emit 0..n rows per input row;
    it runs once per Arrow batch inside the task that reads the partition, or once per ``rows`` rows
    of one (for functions whose output is much larger than their input).
    """
    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for k in range(0, len(pdf), rows or max(1, len(pdf))):
                yield fn(pdf.iloc[k:k + (rows or len(pdf))])
    return df.mapInPandas(run, schema)


def scalar_udf(fn: Callable, return_type: str):
    """UDF-1: vectorised user function ``pandas.Series -> pandas.Series`` as a Column function."""
    import pandas as pd

    def series_fn(s):
        return fn(s)
    series_fn.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(series_fn, return_type)


def apply_operator(df: DataFrame, op: Callable[..., DataFrame], *others: DataFrame) -> DataFrame:
    """UDF-7: custom operator ``DataFrame [, DataFrame] -> DataFrame`` in a chain."""
    return df.transform(lambda d: op(d, *others))
