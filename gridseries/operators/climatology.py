"""Seasonal cycle over a reference period, and its mapping onto dates."""

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import check_frequency, raise_if, require_columns, require_series
from gridseries.functions import day_key, number, parse_date

EMPTY_REFERENCE = "the reference period holds no valid value"


def _season(frequency: str) -> list[Column]:
    """Columns that name a date's place in the year."""
    month = F.month(C.DATE)
    return [month] if frequency == "month" else [month, F.dayofmonth(C.DATE)]


def season_key(frequency: str) -> Column:
    """Key of the seasonal cycle: month number or ``MM-DD``."""
    check_frequency(frequency)
    return F.month(C.DATE) if frequency == "month" else day_key(C.DATE)


def period_bounds(start: str | dt.date, end: str | dt.date) -> tuple[dt.date, dt.date]:
    """Dates that bound a period; ``YYYY`` and ``YYYY-MM`` mean the whole of it."""

    def parts(bound):
        return bound.split("-") if isinstance(bound, str) and bound.count("-") < 2 else None

    def first(bound):
        short = parts(bound)
        return parse_date("-".join((short + ["01"])[:2] + ["01"]) if short else bound)

    def last(bound):
        short = parts(bound)
        if not short:
            return parse_date(bound)
        month = first("-".join((short + ["12"])[:2]))
        return month.replace(day=calendar.monthrange(month.year, month.month)[1])

    return first(start), last(end)


def _in_reference(start: str | dt.date, end: str | dt.date, value: str) -> Column:
    lower, upper = period_bounds(start, end)
    return F.col(C.DATE).between(F.lit(lower), F.lit(upper)) & number(value).isNotNull()


def reference_period(
    series: DataFrame,
    *,
    value: str = C.SERIES_VALUE,
    reference_start: str | dt.date = C.REFERENCE_START,
    reference_end: str | dt.date = C.REFERENCE_END,
) -> DataFrame:
    """Valid rows of the reference period, both bounds included."""
    require_series(series, (), value)
    return series.filter(_in_reference(reference_start, reference_end, value))


def seasonal_cycle(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    frequency: str = "dayofyear",
    reference_start: str | dt.date = C.REFERENCE_START,
    reference_end: str | dt.date = C.REFERENCE_END,
    value: str = C.SERIES_VALUE,
) -> DataFrame:
    """Mean per calendar day or month over the reference period."""
    check_frequency(frequency)
    require_series(series, keys, value)
    reference = reference_period(
        series, value=value, reference_start=reference_start, reference_end=reference_end
    )
    return reference.groupBy(*keys, season_key(frequency).alias("season")).agg(
        F.avg(number(value)).alias(value)
    )


def map_seasonal_cycle(
    series: DataFrame,
    cycle: DataFrame,
    *,
    keys: Sequence[str] = (),
    frequency: str = "dayofyear",
    value: str = C.SERIES_VALUE,
) -> DataFrame:
    """Add ``climatology_celsius`` from a cycle; NULL for a season it lacks.

    The cycle grows with the number of series, so the join carries no hint:
    Spark sees its size and picks the strategy.
    """
    require_columns(cycle, [*keys, "season", value], "cycle")
    means = cycle.select(*keys, "season", F.col(value).alias(C.CLIMATOLOGY))
    return (
        series.withColumn("season", season_key(frequency))
        .join(means, [*keys, "season"], "left")
        .select(*series.columns, C.CLIMATOLOGY)
    )


def calculate_climatology(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    frequency: str = "dayofyear",
    reference_start: str | dt.date = C.REFERENCE_START,
    reference_end: str | dt.date = C.REFERENCE_END,
    value: str = C.SERIES_VALUE,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The cycle mapped onto every date, and the cycle itself.

    ``strict`` runs one job that rejects a series without any valid value in
    the reference period.
    """
    cycle = seasonal_cycle(
        series,
        keys=keys,
        frequency=frequency,
        reference_start=reference_start,
        reference_end=reference_end,
        value=value,
    )
    if strict:
        in_reference = _in_reference(reference_start, reference_end, value)
        usable = series.groupBy(*keys).agg(F.count_if(in_reference).alias("_usable"))
        if not usable.filter("_usable = 0").isEmpty():
            raise ValueError(EMPTY_REFERENCE)
    mapped = map_seasonal_cycle(
        series.select(*keys, C.DATE), cycle, keys=keys, frequency=frequency, value=value
    )
    return mapped, cycle


def with_climatology(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    frequency: str = "dayofyear",
    reference_start: str | dt.date = C.REFERENCE_START,
    reference_end: str | dt.date = C.REFERENCE_END,
    value: str = C.SERIES_VALUE,
    strict: bool = False,
) -> DataFrame:
    """Add ``climatology_celsius`` computed from the series itself.

    Same values as :func:`calculate_climatology`, as a window over the days of
    one season. A series that is already partitioned by its keys, as it is after
    gap filling, is not shuffled again, read twice or joined. ``strict`` fails
    the query for a series without valid values in the reference period.
    """
    check_frequency(frequency)
    require_series(series, keys, value)
    in_reference = _in_reference(reference_start, reference_end, value)
    season = [f"_season{i}" for i, _ in enumerate(_season(frequency))]
    keyed = series.withColumns(
        {
            **dict(zip(season, _season(frequency))),
            "_reference": F.when(in_reference, number(value)),
        }
    )
    mean = F.avg("_reference").over(Window.partitionBy(*keys, *season))
    if strict:
        usable = F.count("_reference").over(Window.partitionBy(*keys))
        keyed = keyed.withColumn("_usable", usable)
        mean = raise_if(F.col("_usable") == 0, EMPTY_REFERENCE, mean)
    return keyed.withColumn(C.CLIMATOLOGY, mean).select(*series.columns, C.CLIMATOLOGY)
