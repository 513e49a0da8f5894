"""Daily means of a grid whose files arrive over time.

Each micro-batch is reduced to sums and bits of cells (``operators.word_sums``),
which are stored as a partition of its own. They add up over batches, so grids that
were reduced once are never read again, a day may come in several batches, and a
cell that comes twice is found, also across batches.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C
from gridseries import schemas
from gridseries.checks import require_columns
from gridseries.operators.spatial import (
    covered,
    grid_weight,
    merged_words,
    sums_of_words,
    word_sums,
)
from gridseries.sources import prepare_grid


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_grid(
    spark: SparkSession,
    source_path: str,
    path: str,
    *,
    cells: DataFrame,
    keys: Sequence[str] = (),
    key_fields: Sequence[T.StructField] = (),
    late_days: int = 30,
    files_per_batch: int | None = None,
) -> None:
    """Reduce the Parquet grid files below ``source_path`` that are new since the
    last run into the tables at ``path``; ends when all have been read.

    ``cells`` names the cells of the grid. It is stored by the first run and taken
    from there by later ones, as stored bits refer to it. Where a run was ended,
    the next one goes on; a batch that is done again replaces its own sums. Rows
    more than ``late_days`` before the last day of earlier batches count as late:
    they are added all the same, and :func:`stream_progress` tells their number.
    """
    if late_days < 0:
        raise ValueError(f"late_days must not be negative, got {late_days!r}")
    require_columns(cells, [C.LAT, C.LON], "cells")
    labels = _folder(path, "cells")
    if not _exists(spark, _folder(labels, "_SUCCESS")):
        cells.select(C.LAT, C.LON).distinct().write.mode("overwrite").parquet(labels)
    known = spark.read.parquet(labels)
    schema = T.StructType([*key_fields, *schemas.GRID.fields])
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", "*.parquet")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = reader.parquet(source_path)
    timed = arriving.withColumn("time", F.col(C.DATE).cast("timestamp"))
    timed = timed.withWatermark("time", f"{late_days} days")

    def reduce(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        sums_path = _folder(path, f"sums/batch={number}")
        sums = word_sums(prepare_grid(batch.drop("time"), keys=keys), keys=keys, cells=known)
        sums.write.mode("overwrite").parquet(sums_path)
        written = session.read.schema(sums.schema).parquet(sums_path)
        last = None
        if number:
            earlier = session.read.parquet(_folder(path, "progress")).filter(F.col("batch") < number)
            last = earlier.agg(F.max("last_date")).first()[0]
        late = F.lit(False) if last is None else F.col(C.DATE) < F.date_sub(F.lit(last), late_days)
        written.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(late, F.col("rows"))), F.lit(0)).alias("late_rows"),
            F.min(C.DATE).alias("first_date"),
            F.max(C.DATE).alias("last_date"),
        ).write.mode("overwrite").parquet(_folder(path, f"progress/batch={number}"))

    query = (
        timed.writeStream.foreachBatch(reduce)
        .option("checkpointLocation", _folder(path, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_progress(spark: SparkSession, path: str) -> DataFrame:
    """Per batch: ``rows``, ``late_rows``, ``first_date`` and ``last_date``."""
    progress = spark.read.parquet(_folder(path, "progress"))
    return progress.select("batch", "rows", "late_rows", "first_date", "last_date")


def daily_of_stream(
    spark: SparkSession, path: str, *, keys: Sequence[str] = (), cells: DataFrame | None = None
) -> DataFrame:
    """Means and covered shares per day (see ``operators.coverage_by_day``) of all
    that :func:`stream_grid` has reduced so far. A cell that came twice on a date
    fails the query. ``cells`` (with ``keys``) is by default what the stream knows."""
    sums = merged_words(spark.read.parquet(_folder(path, "sums")), keys=keys)
    cells = cells if cells is not None else spark.read.parquet(_folder(path, "cells"))
    return covered(sums_of_words(sums, keys=keys), grid_weight(cells, keys=keys), keys=keys)
