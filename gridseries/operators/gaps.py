"""Regular daily calendar with bounded linear interpolation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import check_max_gap_days, require_series
from gridseries.functions import line_through, number
from gridseries.operators._keyed import (
    by_date,
    days_until,
    next_date,
    next_not_null,
    unrepeated,
)
from gridseries.operators.calendar import regularize


def bracket_valid(
    series: DataFrame, *, keys: Sequence[str] = (), value: str = C.SERIES_VALUE
) -> DataFrame:
    """Each row with the valid observation at or before it and the one after it.

    Adds ``previous_date``, ``previous_value``, ``following_date`` and
    ``following_value``, and ``next_date``, the date of the row that comes next.
    One shuffle on the keys and one sort serve all of them. A repeated date
    fails the query.
    """
    require_series(series, keys, value)
    # The date of an observation is NULL where its value is, so the nearest
    # date and the nearest value always belong to the same row.
    flat = series.select(*keys, C.DATE, number(value).alias(value)).withColumn(
        "_seen", F.when(F.col(value).isNotNull(), F.col(C.DATE))
    )
    up_to_here = by_date(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flat.select(
        *keys,
        C.DATE,
        value,
        F.last("_seen", ignorenulls=True).over(up_to_here).alias("previous_date"),
        F.last(value, ignorenulls=True).over(up_to_here).alias("previous_value"),
        next_not_null("_seen", keys).alias("following_date"),
        next_not_null(value, keys).alias("following_value"),
        next_date(keys).alias("next_date"),
    ).withColumn(C.DATE, unrepeated("next_date", F.col(C.DATE)))


def regularize_and_fill(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    max_gap_days: int = C.MAX_GAP_DAYS,
    value: str = C.SERIES_VALUE,
) -> DataFrame:
    """Daily calendar; in every inner gap the first ``max_gap_days`` are filled.

    A filled day lies on the straight line between the valid days around the
    gap. Later days of a longer gap, and days before the first or after the last
    valid day, stay missing. ``is_interpolated`` marks the filled days.
    """
    check_max_gap_days(max_gap_days)
    if max_gap_days == 0:
        return regularize(series, keys=keys, value=value).withColumn(
            C.INTERPOLATED, F.lit(False)
        )
    since_valid = F.datediff(C.DATE, "previous_date") + F.col("_offset")
    line = line_through(
        since_valid.cast("double"),
        F.col("previous_value"),
        F.datediff("following_date", "previous_date").cast("double"),
        F.col("following_value"),
    )
    present = (F.col("_offset") == 0) & F.col("_own").isNotNull()
    return (
        bracket_valid(series, keys=keys, value=value)
        .select(
            *keys,
            C.DATE,
            F.col(value).alias("_own"),
            "previous_date",
            "previous_value",
            "following_date",
            "following_value",
            days_until("next_date").alias("_offset"),
        )
        .select(
            *keys,
            F.date_add(C.DATE, F.col("_offset")).alias(C.DATE),
            present.alias("_present"),
            F.when(present, F.col("_own"))
            .when(since_valid <= max_gap_days, line)
            .alias(value),
        )
        .withColumn(C.INTERPOLATED, ~F.col("_present") & F.col(value).isNotNull())
        .drop("_present")
    )
