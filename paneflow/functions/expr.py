"""Scalar functions (FN-1 … FN-13) and projection helpers (PRJ-*).

All are Column builders over Spark built-ins, so they run inside whole-stage
codegen and work on batch and streaming frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneflow.operators.windows import col_of

# ---------------------------------------------------------------- FN-1 … FN-3


def int_add(*cols) -> Column:
    """FN-1: n-ary integer addition."""
    return reduce(lambda a, b: a + b, [col_of(c) for c in cols])


def int_sub(*cols) -> Column:
    """FN-1: n-ary integer subtraction, left to right."""
    return reduce(lambda a, b: a - b, [col_of(c) for c in cols])


def int_mul(*cols) -> Column:
    """FN-1: n-ary integer multiplication."""
    return reduce(lambda a, b: a * b, [col_of(c) for c in cols])


def int_div(*cols) -> Column:
    """FN-1: n-ary integer division truncating toward zero (SQL ``div``, not ``/``)."""
    return reduce(lambda a, b: F.call_function("div", a, b), [col_of(c) for c in cols])


def float_mul(*cols) -> Column:
    """FN-2: float multiplication."""
    return reduce(lambda a, b: a * b, [col_of(c).cast("double") for c in cols])


def float_div(*cols) -> Column:
    """FN-2: float division."""
    return reduce(lambda a, b: a / b, [col_of(c).cast("double") for c in cols])


_TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double",
          "byte": "tinyint"}


def ref(name: str, kind: str | None = None) -> Column:
    """FN-3: typed column reference."""
    c = F.col(name)
    return c.cast(_TYPES[kind]) if kind else c


def const(value, kind: str | None = None) -> Column:
    """FN-3: typed constant."""
    c = F.lit(value)
    return c.cast(_TYPES[kind]) if kind else c


def nested_projection(c, depth: int, mul: float = 3.0, div: float = 2.0) -> Column:
    """PRJ-2: ``3*x/2`` nested ``depth`` times as one folded expression."""
    e = col_of(c).cast("double")
    for _ in range(depth):
        e = F.lit(mul) * e / F.lit(div)
    return e


# ---------------------------------------------------------------- domain functions

# Offsets, scale and multiplier of the trip region id, cells, feet of a road
# segment, vehicles and speed limit of the toll rule.
GEO_LON_OFFSET, GEO_LAT_OFFSET, GEO_SCALE, GEO_MULTIPLIER, GEO_CELLS = 750.0, 1400.0, 100.0, 12345, 100
SEGMENT_FEET = 5280
TOLL_VEHICLES, TOLL_SPEED = 50, 40.0

def geo_cell(lon, lat) -> Column:
    """FN-9: NYT region id ``(trunc((lon+750)*100) + 12345*trunc((lat+1400)*100)) % 100``."""
    x = ((col_of(lon) + F.lit(GEO_LON_OFFSET)) * F.lit(GEO_SCALE)).cast("long")
    y = ((col_of(lat) + F.lit(GEO_LAT_OFFSET)) * F.lit(GEO_SCALE)).cast("long")
    return (x + F.lit(GEO_MULTIPLIER) * y) % GEO_CELLS


def segment(pos, feet: int = SEGMENT_FEET) -> Column:
    """FN-10: Linear Road segment ``pos div 5280``."""
    return F.call_function("div", col_of(pos), F.lit(feet))


def toll(vehicles, avg_speed, threshold: int = TOLL_VEHICLES, speed_limit: float = TOLL_SPEED,
         compat: str = "clean") -> Column:
    """FN-11: Linear Road toll ``2*(n - threshold)^2`` when ``n > threshold`` and the
    average speed is below ``speed_limit``, else 0.

    ``compat="reference"`` reproduces the variant where ``^`` is a bitwise XOR:
    ``(2*(n - threshold)) XOR 2``.
    """
    n = col_of(vehicles).cast("long")
    d = n - F.lit(threshold)
    val = (F.lit(2) * d).bitwiseXOR(F.lit(2)) if compat == "reference" else F.lit(2) * d * d
    return F.when((n > threshold) & (col_of(avg_speed) < speed_limit), val).otherwise(F.lit(0)) \
            .cast("long")


def pack_pair(hi, lo) -> Column:
    """FN-12: two 32-bit timestamps in one long: ``hi << 32 | lo``."""
    return F.shiftleft(col_of(hi).cast("long"), 32).bitwiseOR(
        col_of(lo).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_hi(packed) -> Column:
    """FN-12: high 32 bits."""
    return F.shiftrightunsigned(col_of(packed).cast("long"), 32)


def unpack_lo(packed) -> Column:
    """FN-12: low 32 bits."""
    return col_of(packed).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def uuid_low64(u) -> Column:
    """FN-13: low 64 bits of a textual UUID as a signed long."""
    hexs = F.substring(F.regexp_replace(col_of(u), "-", ""), 17, 16)
    return F.conv(hexs, 16, -10).cast("long")


def uuid_from_long(x) -> Column:
    """Textual UUID whose 64 low bits are ``x`` (helper to build test keys)."""
    h = F.lpad(F.lower(F.hex(col_of(x).cast("long"))), 16, "0")
    return F.concat(F.lit("00000000-0000-0000-"), F.substring(h, 1, 4), F.lit("-"),
                    F.substring(h, 5, 12))


def key_pair(value, tag) -> Column:
    """PRJ-4: key-tagging map ``x -> (x, tag)`` as a struct."""
    return F.struct(col_of(value).alias("k"), F.lit(tag).alias("side"))
