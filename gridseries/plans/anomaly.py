"""From a grid to the anomaly table."""

import datetime as dt
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.operators import (
    Region,
    area_weighted_mean_sst,
    grid_convention,
    region_atoms,
    region_cells,
    regularize_and_fill,
    select_region,
    with_climatology,
)
from gridseries.operators.region import NO_OVERLAP, regions_of_atoms, within_span
from gridseries.operators.spatial import covered, daily_sums, grid_labels, masked, weight_of_labels
from gridseries.session import discard, stored
from gridseries.sinks import write_csv
from gridseries.sources import read_grid

LOGGER = logging.getLogger(__name__)


def build_anomaly_table(
    regional_sst: DataFrame,
    *,
    keys: Sequence[str] = (),
    max_gap_days: int = C.MAX_GAP_DAYS,
    climatology: str = "dayofyear",
    reference_start: str | dt.date = C.REFERENCE_START,
    reference_end: str | dt.date = C.REFERENCE_END,
    strict: bool = False,
) -> DataFrame:
    """Filled series, its climatology and the difference of the two.

    Filled days count in the climatology. The whole table takes one shuffle on
    the keys after the input: filling, seasonal means and differences all work
    on that partitioning.
    """
    filled = regularize_and_fill(regional_sst, keys=keys, max_gap_days=max_gap_days)
    return with_climatology(
        filled,
        keys=keys,
        frequency=climatology,
        reference_start=reference_start,
        reference_end=reference_end,
        strict=strict,
    ).withColumn(C.ANOMALY, F.col(C.SERIES_VALUE) - F.col(C.CLIMATOLOGY))


def regional_series(
    grid: DataFrame,
    region: Region,
    *,
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    cells: DataFrame | None = None,
    nonnegative_lon: bool | None = None,
    strict: bool = False,
    allow_wrap: bool = False,
) -> DataFrame:
    """Daily area-weighted mean of one region of a grid."""
    convention = {"cells": cells, "nonnegative_lon": nonnegative_lon, "allow_wrap": allow_wrap}
    inside = select_region(grid, region, strict=strict, **convention)
    if cells is not None:
        cells = select_region(cells, region, **convention)
    return area_weighted_mean_sst(
        inside,
        min_valid_fraction=min_valid_fraction,
        output=C.SERIES_VALUE,
        cells=cells,
    )


def series_of_regions(
    grid: DataFrame,
    regions: DataFrame,
    *,
    name: str = "region",
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    cells: DataFrame | None = None,
    nonnegative_lon: bool | None = None,
    strict: bool = False,
    allow_wrap: bool = False,
) -> DataFrame:
    """Daily area-weighted mean of every region of a table, in one pass.

    ``name`` is the column that names the regions and the key of the result. Grid
    rows are reduced to daily sums of the cells that the same regions hold; only
    these sums are counted for each region, so the work on raw rows does not grow
    with the overlap of regions. Without ``cells`` one pass over two columns finds
    them. Cells and regions are matched at once, in jobs of their own. A
    region off the grid has no days in it; ``strict`` runs one job over the
    cells and fails if there is one. ``operators.region_cells`` lists them all.
    """
    if nonnegative_lon is None:
        nonnegative_lon = grid_convention(cells if cells is not None else grid)
    if strict:
        labels = cells if cells is not None else grid
        counted = region_cells(
            regions, labels, name=name, nonnegative_lon=nonnegative_lon, allow_wrap=allow_wrap
        )
        if not counted.filter("cells = 0").isEmpty():
            raise ValueError(NO_OVERLAP)

    if cells is None:
        cells = stored(grid.select(C.LAT, C.LON).distinct(), "cells")
    atoms = region_atoms(
        regions, cells, name=name, nonnegative_lon=nonnegative_lon, allow_wrap=allow_wrap
    )
    of_cells = atoms.select(C.LAT, C.LON, "_atom")
    inside = within_span(grid, atoms, C.LAT, C.LAT, C.LON, C.LON).join(of_cells, [C.LAT, C.LON])
    daily = daily_sums(inside, keys=["_atom"], cells=atoms)
    sums = ["_total", "valid_weight", "_valid", "cells", "rows"]
    held = regions_of_atoms(atoms)
    by_region = daily.join(held, "_atom").groupBy(name, C.DATE).agg(*[F.sum(c).alias(c) for c in sums])
    labels = grid_labels(atoms, keys=["_atom"]).join(held, "_atom").drop("_atom").distinct()
    full = weight_of_labels(labels, keys=[name])
    return masked(
        covered(by_region, full, keys=[name]),
        keys=[name],
        min_valid_fraction=min_valid_fraction,
        output=C.SERIES_VALUE,
    )


def load_regional_sst(
    spark: SparkSession,
    path: str | Sequence[str],
    region: Region,
    *,
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    format: str = "parquet",
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    pattern: str | None = None,
    recursive: bool = False,
    cells: DataFrame | None = None,
    strict: bool = True,
    allow_wrap: bool = False,
) -> DataFrame:
    """Read grid files and reduce them to the daily series of one region.

    ``strict`` first rejects several depth levels and a region off the grid. A
    cell that occurs twice on a date fails while the plan runs. Without
    ``cells`` one pass over two columns finds them and stores them in the
    scratch folder, so that nothing else looks at the grid's labels.
    """
    grid = read_grid(
        spark, path, format=format, start=start, end=end,
        pattern=pattern, recursive=recursive, strict=strict,
    )
    if cells is None:
        cells = stored(grid.select(C.LAT, C.LON).distinct(), "cells")
    return regional_series(
        grid,
        region,
        min_valid_fraction=min_valid_fraction,
        cells=cells,
        nonnegative_lon=grid_convention(cells),
        strict=strict,
        allow_wrap=allow_wrap,
    )


def preprocess_job(
    spark: SparkSession,
    input_path: str | Sequence[str],
    output_path: str,
    *,
    region: Region = Region(),
    max_gap_days: int = C.MAX_GAP_DAYS,
    min_valid_fraction: float = C.MIN_VALID_FRACTION,
    climatology: str = "dayofyear",
    climatology_start: str | dt.date = C.REFERENCE_START,
    climatology_end: str | dt.date = C.REFERENCE_END,
    format: str = "parquet",
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    pattern: str | None = None,
    recursive: bool = False,
    cells: DataFrame | None = None,
    strict: bool = True,
    allow_wrap: bool = False,
) -> int:
    """Grid files in, anomaly table out as CSV; returns the number of days.

    The table is made in the scratch folder first, so that a check that fails
    leaves the output of an earlier run as it is.
    """
    series = load_regional_sst(
        spark,
        input_path,
        region,
        min_valid_fraction=min_valid_fraction,
        format=format,
        start=start,
        end=end,
        pattern=pattern,
        recursive=recursive,
        cells=cells,
        strict=strict,
        allow_wrap=allow_wrap,
    )
    table = build_anomaly_table(
        series,
        max_gap_days=max_gap_days,
        climatology=climatology,
        reference_start=climatology_start,
        reference_end=climatology_end,
        strict=True,
    )
    made = stored(table, "anomaly")
    rows = write_csv(made, output_path)
    discard(spark, made)
    LOGGER.info("wrote %d daily rows to %s", rows, output_path)
    return rows
