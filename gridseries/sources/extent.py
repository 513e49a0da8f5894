"""What file footers tell about a stored grid."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries import constants as C


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own in which aggregates of whole Parquet files are taken
    from their footers; the settings of ``spark`` stay as they are."""
    session = spark.newSession()
    formats = session.conf.get("spark.sql.sources.useV1SourceList", "").split(",")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(f for f in formats if f != "parquet"))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def extent_of_files(session: SparkSession, path: str) -> DataFrame:
    """Number of rows, and least and greatest date, latitude and longitude."""
    ends = [f(c).alias(f"{c}_{n}") for c in (C.DATE, C.LAT, C.LON) for f, n in ((F.min, "min"), (F.max, "max"))]
    return session.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *ends)


def grid_extent(spark: SparkSession, path: str) -> DataFrame:
    """One row that describes a grid written by ``sinks.write_grid``: its rows and
    the ends of its dates, latitudes and longitudes, which also tell the convention
    of its longitudes.

    Runs one job that reads file footers only, whatever the size of the grid.
    """
    found = extent_of_files(footer_session(spark), path)
    return spark.createDataFrame(found.collect(), found.schema)
