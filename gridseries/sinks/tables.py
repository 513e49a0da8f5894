"""Writers of grid tables, result tables and metadata."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C
from gridseries.checks import require_columns
from gridseries.functions import month_stamp


def write_grid(
    grid: DataFrame, path: str, *, band_degrees: float = 10.0, mode: str = "overwrite"
) -> None:
    """Write a grid as Parquet, one directory per month, sorted by cell.

    Rows are spread by month and latitude band and the partitions rebalanced by
    size while the job runs: a month that holds most of the table is split over
    many tasks, small ones share a task. Each file stays within few latitudes,
    so a box filter skips most row groups and pages.
    """
    require_columns(grid, [C.DATE, C.LAT, C.LON, C.GRID_VALUE], "grid")
    (
        grid.withColumns(
            {
                C.MONTH_PARTITION: month_stamp(C.DATE),
                "_band": F.floor(F.col(C.LAT) / band_degrees),
            }
        )
        .hint("rebalance", F.col(C.MONTH_PARTITION), F.col("_band"))
        .drop("_band")
        .sortWithinPartitions(C.MONTH_PARTITION, C.LAT, C.LON, C.DATE)
        .write.partitionBy(C.MONTH_PARTITION)
        .mode(mode)
        .parquet(path)
    )


def write_cells(grid: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write the distinct cells of a grid.

    Given to the operators as ``cells``, this small table answers everything
    they ask about the grid's labels without another pass over it.
    """
    require_columns(grid, [C.LAT, C.LON], "grid")
    grid.select(C.LAT, C.LON).distinct().write.mode(mode).parquet(path)


def _csv_column(field: T.StructField) -> Column:
    """Booleans as ``True``/``False``; the other types as the writer has them."""
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(F.col(field.name).cast("string")).alias(field.name)
    return F.col(field.name)


def write_csv(
    table: DataFrame, path: str, *, keys: Sequence[str] = (), mode: str = "overwrite"
) -> int:
    """Write a table as CSV in date order with a header; returns the row count.

    The part files of a single series follow one another in date order. With
    ``keys`` the series are spread over files of even size and each file is in
    order of keys and date; a global order would cost a sampling pass over the
    whole plan. The count is taken while the rows are written.
    """
    require_columns(table, [*keys, C.DATE], "table")
    written = Observation("written")
    columns = table.select(*[_csv_column(f) for f in table.schema.fields])
    if keys:
        ordered = columns.hint("rebalance", *map(F.col, keys)).sortWithinPartitions(*keys, C.DATE)
    else:
        ordered = columns.orderBy(C.DATE)
    (
        ordered.observe(written, F.count(F.lit(1)).alias("rows"))
        .write.option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .mode(mode)
        .csv(path)
    )
    return written.get["rows"]


def metadata_text(metadata: DataFrame) -> DataFrame:
    """Each metadata row as indented JSON text in a column ``value``."""
    text = F.to_json(F.struct(*metadata.columns), {"pretty": "true", "ignoreNullFields": "false"})
    return metadata.select(text.alias("value"))


def write_metadata(
    metadata: DataFrame, path: str, *, keys: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Write metadata as UTF-8 JSON: one indented object for a single series,
    one object per line when ``keys`` tell series apart."""
    if keys:
        metadata.write.option("ignoreNullFields", False).mode(mode).json(path)
    else:
        metadata_text(metadata).write.mode(mode).text(path)
