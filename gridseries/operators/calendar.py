"""Calendars: date ranges, regular daily series, alignment, union."""

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import raise_if, require_columns, require_series
from gridseries.functions import number, parse_date
from gridseries.operators._keyed import days_until, next_date


def check_date_range(
    start: str | dt.date,
    end: str | dt.date,
    first_available: dt.date | None = C.FIRST_AVAILABLE_DATE,
) -> tuple[dt.date, dt.date]:
    """Parsed bounds of an inclusive date range, or an error."""
    start, end = parse_date(start), parse_date(end)
    if first_available is not None and start < first_available:
        raise ValueError(f"the record begins on {first_available.isoformat()}, not on {start.isoformat()}")
    if end < start:
        raise ValueError(f"the range ends ({end.isoformat()}) before it starts ({start.isoformat()})")
    return start, end


def date_range(
    spark: SparkSession,
    start: str | dt.date,
    end: str | dt.date,
    *,
    first_available: dt.date | None = C.FIRST_AVAILABLE_DATE,
) -> DataFrame:
    """Every date from ``start`` to ``end``, both included."""
    start, end = check_date_range(start, end, first_available)
    days = spark.range((end - start).days + 1)
    return days.select(F.date_add(F.lit(start), F.col("id").cast("int")).alias(C.DATE))


def spanned_dates(
    days: DataFrame, *, first_available: dt.date | None = C.FIRST_AVAILABLE_DATE
) -> DataFrame:
    """Every date from the first to the last one of ``days``, found in the plan.

    A span that begins before ``first_available`` fails the query; no days span
    nothing.
    """
    require_columns(days, [C.DATE], "days")
    bounds = days.agg(F.min(C.DATE).alias("_first"), F.max(C.DATE).alias("_last"))
    first = F.col("_first")
    if first_available is not None:
        early = first < F.lit(first_available)
        first = raise_if(early, f"the record begins on {first_available.isoformat()}", first)
    return bounds.select(F.explode(F.sequence(first, "_last")).alias(C.DATE))


def regularize(
    series: DataFrame, *, keys: Sequence[str] = (), value: str = C.SERIES_VALUE
) -> DataFrame:
    """One row per calendar day from each series' first to its last date.

    Days without a row get a NULL value. Each row stands for itself and for the
    days up to the row after it, so the calendar comes from one window pass and
    needs no join with a date table.
    """
    require_series(series, keys, value)
    return (
        series.select(*keys, C.DATE, value, next_date(keys).alias("_next"))
        .select(*keys, C.DATE, value, days_until("_next").alias("_offset"))
        .select(
            *keys,
            F.date_add(C.DATE, F.col("_offset")).alias(C.DATE),
            F.when(F.col("_offset") == 0, number(value)).alias(value),
        )
    )


def align_series(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Columns of two series side by side, on the union of their dates.

    A repeated date on either side fails the query; the check runs on the
    partitioning that the join needs anyway.
    """
    for frame in (left, right):
        require_columns(frame, [*keys, C.DATE], "series")
    return _once(left, keys).join(_once(right, keys), [*keys, C.DATE], "full")


def _once(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys, C.DATE))
    counted = series.withColumn("_times", rows)
    once = raise_if(F.col("_times") > 1, "a date occurs twice in a series", F.lit(True))
    return counted.filter(once).drop("_times")


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames of separate periods by column name."""
    if not frames:
        raise ValueError("no frames to combine")
    return reduce(DataFrame.unionByName, frames)
