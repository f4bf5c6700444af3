"""Column functions of the workflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres to degrees; largest lake areas (km2) and their buffers in degrees, and the buffer beyond.
DEGREES_PER_METRE = 0.000009
LAKE_BUFFERS = ((1, 0.0009), (50, 0.0018), (100, 0.0027))
LAKE_BUFFER_BEYOND = 0.0036


def to_degrees(metres: Column) -> Column:
    return metres * F.lit(DEGREES_PER_METRE)


def lake_buffer(area_km2: Column) -> Column:
    out = F.lit(LAKE_BUFFER_BEYOND)
    for most, width in reversed(LAKE_BUFFERS):
        out = F.when(area_km2 <= most, width).otherwise(out)
    return out


def outward(low: Column, high: Column) -> tuple[Column, Column]:
    """An extent grown to whole degrees: the part before the point, one less for a negative low, one more for a high of 0 or more."""
    cut = lambda c: c.cast("int")
    return F.when(low < 0, cut(low) - 1).otherwise(cut(low)), F.when(high >= 0, cut(high) + 1).otherwise(cut(high))


def truncated(x: Column, digits: int = 3) -> Column:
    """Cut, not rounded, towards zero."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mapped(x: Column, table: dict) -> Column:
    """A value looked up in a small table; null if it is not there."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
    return out


def row_mean(*columns: str) -> Column:
    """Mean of the values that are there."""
    there = F.filter(F.array(*columns), lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(there), F.lit(0))


def row_count(*columns: str) -> Column:
    return F.size(F.filter(F.array(*columns), lambda v: v.isNotNull()))
