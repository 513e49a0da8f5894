"""Numeric column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_weight(lat: Column | str) -> Column:
    """Area weight of a grid cell: cosine of latitude, never below zero."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.greatest(F.cos(F.radians(lat.cast("double"))), F.lit(0.0))


def longitude_value(value: float, nonnegative: bool) -> float:
    """A longitude bound in 0..360 (``nonnegative``) or -180..180 form."""
    shift = 0.0 if nonnegative else 180.0
    return (value + shift) % 360.0 - shift


def longitude_column(value: Column | str, nonnegative: bool) -> Column:
    """Column form of :func:`longitude_value`."""
    value = F.col(value) if isinstance(value, str) else value
    shift = 0.0 if nonnegative else 180.0
    return F.pmod(value.cast("double") + shift, F.lit(360.0)) - shift


def number(value: Column | str) -> Column:
    """A measured value as DOUBLE, with NaN as NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def is_finite(value: Column | str) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    value = F.col(value) if isinstance(value, str) else value
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))


def root_mean_square(value: Column) -> Column:
    """Aggregate: square root of the mean square."""
    return F.sqrt(F.avg(value * value))


def line_through(x: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Value at ``x`` of the line from ``(0, y0)`` to ``(x1, y1)``; no side is NaN.

    With an infinite side the line from the left is NaN. It is then taken from
    the right; two equal sides give that value, and what remains is missing.
    """
    slope = (y1 - y0) / x1
    from_right = slope * (x - x1) + y1
    return F.nanvl(slope * x + y0, F.nanvl(from_right, F.when(y0 == y1, y0)))
