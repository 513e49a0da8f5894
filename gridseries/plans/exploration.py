"""The tables behind the exploratory figures."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridseries import constants as C
from gridseries.operators import (
    acf_band,
    autocorrelation,
    density_curve,
    histogram,
    monthly_means,
    profile,
)
from gridseries.session import stored


def exploration_tables(
    table: DataFrame, *, keys: Sequence[str] = (), keep: bool = True
) -> dict[str, DataFrame]:
    """Profile, both series, monthly means, distribution and autocorrelation.

    Each result is a plan of its own. ``table`` is computed once, into the scratch
    folder, and all of them read that; a table that lies in files already is read
    where it is with ``keep`` set to False.
    """
    if keep:
        table = stored(table, "explored")
    return {
        "profile": profile(table, keys=keys),
        "sst": table.select(*keys, C.DATE, C.SERIES_VALUE),
        "anomaly": table.select(*keys, C.DATE, C.ANOMALY),
        "monthly_means": monthly_means(table, keys=keys),
        "histogram": histogram(table, keys=keys),
        "density": density_curve(table, keys=keys),
        "autocorrelation": acf_band(autocorrelation(table, keys=keys), keys=keys),
    }
