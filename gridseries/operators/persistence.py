"""One-day persistence: tomorrow's forecast is today's value."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import check_test_fraction, raise_if, require_columns, require_series
from gridseries.functions import number
from gridseries.operators._keyed import by_date, days_until, next_date, unrepeated
from gridseries.operators.metrics import metric_columns

TOO_SHORT = "a forecast needs a record of two days or more"
NO_TEST_PAIRS = "the test segment holds no pair of values"


def _with_neighbours(anomaly: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each row with the row before it and the date after it."""
    order = by_date(keys)
    return anomaly.select(*keys, C.DATE, number(value).alias("_own")).select(
        "*",
        F.lag(C.DATE).over(order).alias("_last_date"),
        F.lag("_own").over(order).alias("_last"),
        next_date(keys).alias("_next"),
    )


def _value_of_day_before() -> Column:
    """Value of the calendar day before; NULL when that day has no row."""
    return F.when(F.col("_last_date") == F.date_sub(C.DATE, 1), F.col("_last"))


def persistence_predictions(
    anomaly: DataFrame, *, keys: Sequence[str] = (), value: str = C.ANOMALY
) -> DataFrame:
    """For every calendar day of the series, the value of the day before."""
    require_series(anomaly, keys, value)
    prediction = F.when(F.col("_offset") == 0, F.col("_before")).when(
        F.col("_offset") == 1, F.col("_own")
    )
    return (
        _with_neighbours(anomaly, keys, value)
        .withColumn("_before", _value_of_day_before())
        .select(*keys, C.DATE, "_own", "_before", days_until("_next").alias("_offset"))
        .select(*keys, F.date_add(C.DATE, F.col("_offset")).alias(C.DATE), prediction.alias(C.PREDICTED))
    )


def chronological_split(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    strict: bool = False,
) -> DataFrame:
    """Add ``position``, ``days`` and ``is_test`` to the rows of each series.

    Positions count calendar days from the first date, so a series with absent
    days splits at the same date as the full calendar. The test segment starts
    at ``days * (1 - test_fraction)`` rounded down, at 1 at the earliest. A
    repeated date fails the query.
    """
    check_test_fraction(test_fraction)
    require_columns(series, [*keys, C.DATE], "series")
    whole = Window.partitionBy(*keys)
    first, last = F.min(C.DATE).over(whole), F.max(C.DATE).over(whole)
    days = F.datediff(last, first) + 1
    if strict:
        days = raise_if(days < 2, TOO_SHORT, days)
    split = F.greatest(
        F.lit(1), F.floor(F.col("days").cast("double") * F.lit(1 - test_fraction))
    )
    placed = series.withColumns(
        {
            "_before": F.lag(C.DATE).over(by_date(keys)),
            "position": F.datediff(C.DATE, first),
            "days": days,
        }
    )
    return placed.withColumns(
        {
            "position": unrepeated("_before", F.col("position")),
            "is_test": unrepeated("_before", F.col("position") >= split),
        }
    ).drop("_before")


def evaluate_persistence(
    anomaly: DataFrame,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    value: str = C.ANOMALY,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Predictions on the final part of each series, and their metadata row.

    A day counts when it and the day before it have a value, so the calendar is
    never filled out here: one shuffle on the keys and one sort are enough.
    """
    scored = scored_days(
        anomaly, keys=keys, test_fraction=test_fraction, value=value, strict=strict
    )
    return predictions_of(scored, keys=keys), metadata_of(
        scored, keys=keys, test_fraction=test_fraction, strict=strict
    )


def scored_days(
    anomaly: DataFrame,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    value: str = C.ANOMALY,
    strict: bool = False,
) -> DataFrame:
    """Every day with its value, the forecast of it, and whether it counts:
    ``is_scored`` on days of the test segment that have both."""
    check_test_fraction(test_fraction)
    require_series(anomaly, keys, value)
    paired = _with_neighbours(anomaly, keys, value).select(
        *keys,
        unrepeated("_last_date", F.col(C.DATE)).alias(C.DATE),
        F.col("_own").alias(C.OBSERVED),
        _value_of_day_before().alias(C.PREDICTED),
    )
    split = chronological_split(paired, keys=keys, test_fraction=test_fraction, strict=strict)
    both = F.col(C.OBSERVED).isNotNull() & F.col(C.PREDICTED).isNotNull()
    return split.select(
        *keys, C.DATE, C.OBSERVED, C.PREDICTED, (F.col("is_test") & both).alias("is_scored")
    )


def predictions_of(scored: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """The scored days with their error."""
    error = (F.col(C.PREDICTED) - F.col(C.OBSERVED)).alias(C.ERROR)
    return scored.filter("is_scored").select(*keys, C.DATE, C.OBSERVED, C.PREDICTED, error)


def forecast_metadata(
    predictions: DataFrame,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    strict: bool = False,
) -> DataFrame:
    """One row per series that describes a prediction table.

    The table holds scored days only, so a series without any is not in it; see
    :func:`metadata_of` for the series of a whole table.
    """
    require_columns(predictions, [*keys, C.DATE, C.OBSERVED, C.PREDICTED], "predictions")
    return metadata_of(
        predictions.withColumn("is_scored", F.lit(True)),
        keys=keys, test_fraction=test_fraction, strict=strict,
    )


def metadata_of(
    scored: DataFrame,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    strict: bool = False,
) -> DataFrame:
    """One row per series of :func:`scored_days`, also for a series of which no
    day is scored: its ``n`` is 0 and its metrics are NULL. ``strict`` fails the
    query for such a series."""
    counts = F.col("is_scored")
    marked = scored.withColumns(
        {c: F.when(counts, F.col(c)) for c in (C.DATE, C.OBSERVED, C.PREDICTED)}
    )
    first = F.min(C.DATE)
    if strict:
        first = raise_if(F.count_if("is_scored") == 0, NO_TEST_PAIRS, first)
    metrics = metric_columns(C.OBSERVED, C.PREDICTED, strict=strict)
    return marked.groupBy(*keys).agg(
        F.lit(C.BASELINE_NAME).alias("baseline"),
        F.lit(C.TARGET_NAME).alias("target"),
        F.lit(C.SPLIT_NAME).alias("split_method"),
        F.lit(float(test_fraction)).alias("test_fraction"),
        F.date_format(first, "yyyy-MM-dd").alias("test_start"),
        F.date_format(F.max(C.DATE), "yyyy-MM-dd").alias("test_end"),
        F.lit(C.RANDOM_SEED).cast("long").alias("random_seed"),
        F.struct(*[c.alias(name) for name, c in metrics.items()]).alias("metrics"),
    )
