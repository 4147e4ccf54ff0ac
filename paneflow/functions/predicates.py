"""Predicate builders (FLT-2 … FLT-6, UDF-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneflow.operators.windows import col_of

# comparison operators of the reference predicate classes (fixed set)


def compare(a, op: str, b) -> Column:
    """FLT-2: ``a op b`` for the six comparison operators (columns or literals)."""
    x = col_of(a)
    y = col_of(b) if isinstance(b, (str, Column)) and not isinstance(b, bool) else F.lit(b)
    return {"=": x == y, "!=": x != y, "<": x < y, ">=": x >= y, ">": x > y, "<=": x <= y}[op]


def compare_value(a, op: str, value) -> Column:
    """FLT-2 against a literal value."""
    return compare(a, op, F.lit(value))


def compare_wide(hi_a, lo_a, op: str, hi_b, lo_b) -> Column:
    """FLT-3: 128-bit comparison, high word first, both words signed.

    Struct comparison in Spark is lexicographic with signed longs, the same order.
    """
    return compare(F.struct(col_of(hi_a).alias("hi"), col_of(lo_a).alias("lo")), op,
                   F.struct(col_of(hi_b).alias("hi"), col_of(lo_b).alias("lo")))


def _balanced(terms: Sequence[Column], op) -> Column:
    """Fold terms as a balanced tree (depth log n) instead of a left-deep chain."""
    terms = list(terms)
    if not terms:
        raise ValueError("no terms")
    while len(terms) > 1:
        nxt = [op(terms[i], terms[i + 1]) for i in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def all_of(*terms: Column) -> Column:
    """FLT-4: n-ary AND (short-circuit evaluation is Spark's)."""
    return _balanced(terms, lambda a, b: a & b)


def any_of(*terms: Column) -> Column:
    """FLT-4 / FLT-6: n-ary OR as a balanced tree (a 500-term chain is slow to analyse)."""
    return _balanced(terms, lambda a, b: a | b)


def conjunction(col, n: int, threshold) -> Column:
    """FLT-5: ``n`` conjuncts ``col >= threshold - i`` (selectivity set by threshold)."""
    return all_of(*[F.col(col) >= F.lit(threshold - i) for i in range(n)])


def selectivity_filter(col, selectivity: float, lo: float, hi: float) -> Column:
    """FLT-5: keep about ``selectivity`` of rows for ``col`` uniform in [lo, hi)."""
    return F.col(col) < F.lit(lo + selectivity * (hi - lo))


def failed_task_predicate(n_or: int = 500) -> Column:
    """FLT-6: ``event_type = 3 AND (cpu < 0 OR ram < 0 OR … OR cpu >= 0)``.

    ``n_or`` disjuncts: ``n_or - 1`` terms ``< 0`` over cpu, ram and disk in turn, then
    ``cpu >= 0``.
    """
    cols = ("cpu", "ram", "disk")
    terms = [F.col(cols[i % 3]) < F.lit(0.0) for i in range(n_or - 1)]
    terms.append(F.col("cpu") >= F.lit(0.0))
    return (F.col("event_type") == 3) & any_of(*terms)


def from_text(expr: str) -> Column:
    """UDF-8: a boolean predicate supplied as SQL source text."""
    return F.expr(expr)


def prefix_equals(col, value: str) -> Column:
    """FLT-8: byte-prefix match (``event_type == 'view'`` on fixed-width bytes)."""
    return F.col(col).startswith(value)
