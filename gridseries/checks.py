"""Argument, schema and data checks.

Argument and schema checks run at once and start no job. Checks on the data are
of two kinds: ``raise_if`` puts the check into the plan, so it costs no extra
pass and fires when the plan runs; the ``assert_*`` functions each run one small
job and are used by the jobs in ``gridseries.plans`` or on request.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C


def check_min_valid_fraction(value: float) -> None:
    if not 0 < value <= 1:
        raise ValueError(f"min_valid_fraction must lie in (0, 1], got {value!r}")


def check_max_gap_days(value: int) -> None:
    if value < 0:
        raise ValueError(f"max_gap_days must not be negative, got {value!r}")


def check_frequency(value: str) -> None:
    if value not in ("dayofyear", "month"):
        raise ValueError(f"frequency must be 'dayofyear' or 'month', got {value!r}")


def check_test_fraction(value: float) -> None:
    if not 0 < value < 1:
        raise ValueError(f"test_fraction must lie strictly between 0 and 1, got {value!r}")


def require_columns(frame: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    """Fail with the sorted list of absent columns."""
    absent = sorted(set(columns) - set(frame.columns))
    if absent:
        raise ValueError(f"{what} is missing columns: {absent}")


def require_series(frame: DataFrame, keys: Sequence[str], value: str) -> None:
    """A daily series needs its keys, a DATE column called ``date`` and a value."""
    require_columns(frame, [*keys, C.DATE, value], "series")
    if not isinstance(frame.schema[C.DATE].dataType, T.DateType):
        raise TypeError(
            f"column 'date' must be of type DATE, not {frame.schema[C.DATE].dataType.simpleString()}"
        )


def raise_if(condition: Column, message: str, otherwise: Column) -> Column:
    """``otherwise``, unless ``condition`` holds when the plan runs."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(otherwise)


def duplicate_dates(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dates that occur more than once in a series, with their row count."""
    return (
        series.groupBy(*keys, C.DATE)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def duplicate_cells(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Grid cells that carry more than one row for the same date."""
    return (
        grid.groupBy(*keys, C.DATE, C.LAT, C.LON)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def assert_unique_dates(series: DataFrame, keys: Sequence[str] = ()) -> None:
    if not duplicate_dates(series, keys).isEmpty():
        raise ValueError("a date occurs twice in a series")


def assert_unique_cells(grid: DataFrame, keys: Sequence[str] = ()) -> None:
    if not duplicate_cells(grid, keys).isEmpty():
        raise ValueError("a cell occurs twice on a date")
