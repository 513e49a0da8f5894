"""Long-form grid tables: one row per date and cell."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C
from gridseries.checks import require_columns
from gridseries.functions import parse_date
from gridseries.schemas import nan_to_null


def prepare_grid(
    raw: DataFrame, *, keys: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Bring a raw table to ``(date, lat, lon, sst)``; drop everything else.

    The day comes from ``date`` or ``time``. A depth column ``zlev`` is dropped;
    ``strict`` runs one job over it and fails when it holds several levels.
    Types that already fit are left alone, so filters still reach the files.
    """
    when = C.DATE if C.DATE in raw.columns else "time"
    require_columns(raw, [*keys, when, C.LAT, C.LON, C.GRID_VALUE], "grid")
    if strict and "zlev" in raw.columns:
        low, high = raw.agg(F.min("zlev"), F.max("zlev")).first()
        if low != high:
            raise ValueError("the grid holds more than one depth level")

    def double(name):
        column = F.col(name)
        fits = isinstance(raw.schema[name].dataType, T.DoubleType)
        return column if fits else column.cast("double").alias(name)

    day = F.col(when)
    if not isinstance(raw.schema[when].dataType, T.DateType):
        day = F.to_date(day)
    grid = raw.select(
        *keys, day.alias(C.DATE), double(C.LAT), double(C.LON), double(C.GRID_VALUE)
    )
    return nan_to_null(grid, [C.GRID_VALUE])


def read_grid(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    format: str = "parquet",
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    pattern: str | None = None,
    recursive: bool = False,
    keys: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Read the grid files below ``path`` as one table.

    ``pattern`` restricts the file names. ``recursive`` also looks into plain
    folders such as ``YYYYMM``, in place of ``name=value`` partition folders.

    ``start`` and ``end`` bound the dates. On a table written by
    ``sinks.write_grid`` they also become a filter on its month partitions, so
    files of other months are not opened.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise FileNotFoundError("no grid files were given")
    reader = spark.read.format(format).option("recursiveFileLookup", recursive)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if format == "csv":
        # No schema: columns are found by name and cast by prepare_grid.
        reader = reader.option("header", True)
    raw = reader.load(paths)
    when = C.DATE if C.DATE in raw.columns else "time"
    require_columns(raw, [when], "grid")
    for bound, is_start in ((start, True), (end, False)):
        if bound is None:
            continue
        bound = parse_date(bound)
        if C.MONTH_PARTITION in raw.columns:
            month = F.lit(f"{bound:%Y%m}").cast(raw.schema[C.MONTH_PARTITION].dataType)
            partition = F.col(C.MONTH_PARTITION)
            raw = raw.filter(partition >= month if is_start else partition <= month)
        edge = F.lit(bound if is_start else bound + dt.timedelta(days=1))
        raw = raw.filter(F.col(when) >= edge if is_start else F.col(when) < edge)
    return prepare_grid(raw, keys=keys, strict=strict)

