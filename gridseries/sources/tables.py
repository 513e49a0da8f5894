"""Readers of the stored anomaly table."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries import schemas
from gridseries.checks import require_columns
from gridseries.schemas import nan_to_null
from gridseries.sources.buckets import read_series


def _read(
    spark: SparkSession, path: str, required: Sequence[str], keys: Sequence[str], format: str
) -> DataFrame:
    if format == "csv":
        # Columns are found by their header name and cast afterwards: a schema
        # given to the CSV reader would be applied by position.
        table = spark.read.option("header", True).csv(path)
    elif format == "series":
        table = read_series(spark, path)
    else:
        table = spark.read.format(format).load(path)
    require_columns(table, [*keys, C.DATE, *required], "table")
    types = {f.name: f.dataType for f in schemas.ANOMALY_TABLE}
    known = [c for c in table.columns if c in types]
    table = table.select(
        *keys, *[F.col(c).cast(types[c]).alias(c) for c in known if c not in keys]
    )
    return nan_to_null(table, known)


def read_anomaly_table(
    spark: SparkSession, path: str, *, keys: Sequence[str] = (), format: str = "csv"
) -> DataFrame:
    """The stored table with dates parsed; needs ``anomaly_celsius``.

    ``format`` is ``csv``, ``series`` for a table that ``sinks.write_series`` has
    stored by its keys, or a format of Spark's.
    """
    return _read(spark, path, [C.ANOMALY], keys, format)


def read_exploration_table(
    spark: SparkSession, path: str, *, keys: Sequence[str] = (), format: str = "csv"
) -> DataFrame:
    """The stored table; needs the value, its climatology and its anomaly."""
    return _read(spark, path, [C.SERIES_VALUE, C.CLIMATOLOGY, C.ANOMALY], keys, format)
