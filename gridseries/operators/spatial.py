"""Area-weighted spatial means with a coverage rule."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import check_min_valid_fraction, raise_if, require_columns
from gridseries.functions import cosine_weight, number
from gridseries.operators._keyed import attach


def grid_weight(cells: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Total area weight and cell count of a grid, missing cells included.

    The grid is the product of its latitude and its longitude labels, over all
    dates. Only distinct labels leave a task, a few thousand values per key, so
    the cost is one pass over two columns.
    """
    require_columns(cells, [*keys, C.LAT, C.LON], "cells")
    return weight_of_labels(grid_labels(cells, keys=keys), keys=keys)


def grid_labels(cells: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct latitudes (``is_lat``) and longitudes of a grid, in column ``at``."""
    label = F.explode(
        F.array(
            F.struct(F.lit(True).alias("is_lat"), F.col(C.LAT).cast("double").alias("at")),
            F.struct(F.lit(False).alias("is_lat"), F.col(C.LON).cast("double").alias("at")),
        )
    )
    return cells.select(*keys, label.alias("label")).select(*keys, "label.*").distinct()


def weight_of_labels(labels: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Total weight and cell count of the grid that :func:`grid_labels` describes."""
    rows, columns = F.count_if("is_lat"), F.count_if(~F.col("is_lat"))
    per_column = F.sum(F.when(F.col("is_lat"), cosine_weight("at")))
    return labels.groupBy(*keys).agg(
        (per_column * columns).alias("full_weight"), (rows * columns).alias("cell_count")
    )


def _longitudes(cells: DataFrame) -> Column:
    """The distinct longitudes of a grid in order, as one array, read in one pass
    over one column of ``cells``. A grid has a few thousand at most."""
    labels = cells.select(F.col(C.LON).cast("double").alias(C.LON)).distinct()
    return labels.agg(F.sort_array(F.collect_list(C.LON)).alias("lons")).scalar()


# Columns of the sums of a word that add up, and those whose bits do.
ADDED, BITS = ("total", "with_value", "rows"), ("bits", "valid_bits")


def word_sums(
    grid: DataFrame, *, keys: Sequence[str] = (), value: str = C.GRID_VALUE, cells: DataFrame
) -> DataFrame:
    """Sums and bits of cells per day, latitude and word of 64 longitudes.

    ``total``, ``with_value`` and ``rows`` add up, ``bits`` and ``valid_bits`` say
    which cells were met, and which with a value. Rows of one day may be reduced
    apart and put together by :func:`merged_words`, if ``cells`` is the same: it
    gives the longitudes, whose places are bits. The place of one among them is
    guessed from their spacing and then checked; a longitude that is not found
    there takes a word of its own.
    """
    require_columns(grid, [*keys, C.DATE, C.LAT, C.LON, value], "grid")
    lons = _longitudes(cells)
    first, last = F.get(lons, F.lit(0)), F.element_at(lons, -1)
    step = F.try_divide(last - first, (F.size(lons) - 1).cast("double"))
    lon = F.col(C.LON).cast("double")
    guess = F.coalesce(F.round(F.try_divide(lon - first, step)), F.lit(0.0)).try_cast("int")
    placed = grid.select(
        *keys, C.DATE, C.LAT, lon.alias("_lon"), number(value).alias("_value"), guess.alias("_at")
    )
    found = F.coalesce(F.get(lons, F.col("_at")) == F.col("_lon"), F.lit(False))
    bit = F.when(F.col("_word").isNotNull(), F.expr("shiftleft(1L, _at % 64)"))
    return (
        placed.withColumns(
            {"_word": F.when(found, F.floor(F.col("_at") / 64)), "_odd": F.when(~found, F.col("_lon"))}
        )
        .withColumn("_bit", bit)
        .groupBy(*keys, C.DATE, C.LAT, "_word", "_odd")
        .agg(
            F.sum("_value").alias("total"),
            F.count("_value").alias("with_value"),
            F.count(F.lit(1)).alias("rows"),
            F.bit_or("_bit").alias("bits"),
            F.bit_or(F.when(F.col("_value").isNotNull(), F.col("_bit"))).alias("valid_bits"),
        )
    )


def merged_words(words: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Word sums of rows that were reduced apart, put together."""
    return words.groupBy(*keys, C.DATE, C.LAT, "_word", "_odd").agg(
        *[F.sum(c).alias(c) for c in ADDED], *[F.bit_or(c).alias(c) for c in BITS]
    )


def sums_of_words(words: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Daily sums (see :func:`daily_sums`) of word sums."""
    own = F.col("_word").isNull()
    valid = F.when(own, F.least("with_value", F.lit(1))).otherwise(
        F.coalesce(F.bit_count("valid_bits"), F.lit(0))
    )
    weight = cosine_weight(C.LAT)
    return words.groupBy(*keys, C.DATE).agg(
        F.sum(weight * F.col("total")).alias("_total"),
        F.coalesce(F.sum(weight * valid), F.lit(0.0)).alias("valid_weight"),
        F.sum(valid).cast("bigint").alias("_valid"),
        F.sum(F.when(own, 1).otherwise(F.bit_count("bits"))).cast("bigint").alias("cells"),
        F.sum("rows").alias("rows"),
    )


def daily_sums(
    grid: DataFrame, *, keys: Sequence[str] = (), value: str = C.GRID_VALUE, cells: DataFrame
) -> DataFrame:
    """Per day: ``_total`` and ``valid_weight`` of the cells with a value, their
    number ``_valid``, distinct ``cells`` and ``rows``; these two differ where a
    cell repeats.

    Sums and bits are built before anything is exchanged, so a row of the grid
    never crosses the network by itself, and what does is up to 64 times less if
    the grid is stored by cell.
    """
    return sums_of_words(word_sums(grid, keys=keys, value=value, cells=cells), keys=keys)


def _share() -> Column:
    """Share of the area with a value: exactly one if every cell has one."""
    return F.when(F.col("_valid") == F.col("cell_count"), 1.0).otherwise(
        F.try_divide("valid_weight", "full_weight")
    )


def coverage_by_day(
    grid: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str = C.GRID_VALUE,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Per day: weighted mean of the valid cells and the share of area they cover.

    ``cells`` names the cells of the grid (with ``keys``) when the grid table
    holds only some of them; by default they are taken from the grid itself. A
    day with every cell valid has a share of exactly one. A cell that occurs
    twice on a date fails the query, however few of the day's cells there are.
    """
    cells = cells if cells is not None else grid
    daily = daily_sums(grid, keys=keys, value=value, cells=cells)
    return covered(daily, grid_weight(cells, keys=keys), keys=keys)


def covered(daily: DataFrame, full: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Means and covered shares from :func:`daily_sums` and :func:`grid_weight`."""
    return attach(daily, full, keys).select(
        *keys,
        C.DATE,
        F.try_divide("_total", "valid_weight").alias("mean"),
        "valid_weight",
        "full_weight",
        raise_if(
            F.col("rows") > F.col("cells"), "a cell occurs twice on a date", _share()
        ).alias("valid_fraction"),
    )


def coverage_quality(
    grid: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str = C.GRID_VALUE,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Per day: rows, distinct cells, and the share of area that cells with a
    value cover. Repeated cells are counted here and fail nothing."""
    cells = cells if cells is not None else grid
    daily = daily_sums(grid, keys=keys, value=value, cells=cells)
    return attach(daily, grid_weight(cells, keys=keys), keys).select(
        *keys, C.DATE, "rows", "cells", _share().alias("valid_fraction")
    )


def area_weighted_mean_sst(
    grid: DataFrame,
    *,
    keys: Sequence[str] = (),
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    value: str = C.GRID_VALUE,
    output: str = C.GRID_VALUE,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Cosine-latitude weighted mean per day; NULL on days with low coverage."""
    found = coverage_by_day(grid, keys=keys, value=value, cells=cells)
    return masked(found, keys=keys, min_valid_fraction=min_valid_fraction, output=output)


def masked(
    coverage: DataFrame,
    *,
    keys: Sequence[str] = (),
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    output: str = C.GRID_VALUE,
) -> DataFrame:
    """The mean of :func:`coverage_by_day` on days with enough coverage, else NULL."""
    check_min_valid_fraction(min_valid_fraction)
    enough = F.col("valid_fraction") >= F.lit(float(min_valid_fraction))
    return coverage.select(*keys, C.DATE, F.when(enough, F.col("mean")).alias(output))
