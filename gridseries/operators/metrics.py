"""Forecast metrics over pairs of finite values."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.checks import raise_if, require_columns
from gridseries.functions import is_finite, root_mean_square

NO_PAIRS = "there is no pair of finite values to score"


def finite_pairs(
    pairs: DataFrame, *, observed: str = "observed", predicted: str = "predicted"
) -> DataFrame:
    """Rows where both values are finite."""
    require_columns(pairs, [observed, predicted], "pairs")
    return pairs.filter(is_finite(observed) & is_finite(predicted))


def metric_columns(observed: str, predicted: str, *, strict: bool = False) -> dict:
    """Aggregates ``n``, ``mae`` and ``rmse`` of predicted minus observed."""
    error = F.when(
        is_finite(observed) & is_finite(predicted), F.col(predicted) - F.col(observed)
    ).cast("double")
    n = F.count(error)
    return {
        "n": raise_if(n == 0, NO_PAIRS, n) if strict else n,
        "mae": F.avg(F.abs(error)),
        "rmse": root_mean_square(error),
    }


def regression_metrics(
    pairs: DataFrame,
    *,
    keys: Sequence[str] = (),
    observed: str = "observed",
    predicted: str = "predicted",
    strict: bool = False,
) -> DataFrame:
    """Sample count, mean absolute error and root mean square error.

    Pairs with a missing or infinite side do not count. ``strict`` fails the
    query when no pair is left.
    """
    require_columns(pairs, [*keys, observed, predicted], "pairs")
    columns = metric_columns(observed, predicted, strict=strict)
    return pairs.groupBy(*keys).agg(*[c.alias(name) for name, c in columns.items()])
