"""The persistence forecast as a job."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries import schemas
from gridseries.operators import metadata_of, predictions_of, scored_days
from gridseries.session import discard, stored
from gridseries.sinks import write_csv, write_metadata
from gridseries.sources import read_anomaly_table


def read_predictions(spark: SparkSession, path: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Read a prediction table written by :func:`persistence_job`."""
    table = spark.read.option("header", True).csv(path)
    return table.select(
        *keys, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PREDICTIONS]
    )


def persistence_job(
    spark: SparkSession,
    input_path: str,
    predictions_path: str,
    metrics_path: str,
    *,
    keys: Sequence[str] = (),
    test_fraction: float = C.TEST_FRACTION,
    format: str = "csv",
    strict: bool = True,
) -> DataFrame:
    """Anomaly table in, predictions and metadata out; returns the metadata.

    A table that ``sinks.write_series`` has stored by its keys (``format="series"``)
    is scored without an exchange.

    The forecast runs once, into the scratch folder. All checks have been passed
    before the tables of an earlier run are touched: with ``strict``, that every
    series has a day to score. Without it, one that has none is in the metadata
    with ``n`` 0.
    """
    table = read_anomaly_table(spark, input_path, keys=keys, format=format)
    options = {"keys": keys, "test_fraction": test_fraction, "strict": strict}
    scored = stored(scored_days(table, **options), "scored")
    metadata = stored(metadata_of(scored, **options), "metadata")
    write_csv(predictions_of(scored, keys=keys), predictions_path, keys=keys)
    write_metadata(metadata, metrics_path, keys=keys)
    discard(spark, scored)
    return metadata
