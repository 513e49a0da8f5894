"""Bounding boxes on a long-form grid."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import raise_if, require_columns
from gridseries.functions import longitude_column, longitude_value
from gridseries.session import stored

ANTIMERIDIAN = "the box wraps around at the antimeridian, which is not possible"
OUT_OF_RANGE = "region bounds are out of range or out of order"
NO_OVERLAP = "no cell of the grid lies in the box"
# Which bounds belong together, and the range of degrees each pair must keep to.
LIMITS = [("lat_min", "lat_max", -90.0, 90.0), ("lon_min", "lon_max", -180.0, 360.0)]


@dataclass(frozen=True)
class Region:
    """A box in degrees north and east; its edges belong to it."""

    lat_min: float = 31.0
    lat_max: float = 39.0
    lon_min: float = 117.0
    lon_max: float = 127.0

    def validate(self) -> None:
        for lower, upper, least, greatest in LIMITS:
            if not least <= getattr(self, lower) < getattr(self, upper) <= greatest:
                raise ValueError(
                    f"{lower} must lie below {upper}, both within {least:g} to {greatest:g}"
                )

    def longitudes(
        self, nonnegative: bool, *, allow_wrap: bool = False
    ) -> list[tuple[float, float]]:
        """Ranges from west to east in the grid's longitude convention.

        A box across the seam of the convention has two of them where
        ``allow_wrap`` says so, and is refused otherwise.
        """
        west = longitude_value(self.lon_min, nonnegative)
        east = longitude_value(self.lon_max, nonnegative)
        if west < east:
            return [(west, east)]
        if not allow_wrap:
            raise ValueError(ANTIMERIDIAN)
        start, end = (0.0, 360.0) if nonnegative else (-180.0, 180.0)
        return [(start, end)] if west == east else [(start, east), (west, end)]


def valid_region() -> Column:
    """Whether a row of a regions table has usable bounds; NULL and NaN are not."""
    found = F.lit(True)
    for lower, upper, least, greatest in LIMITS:
        a, b = (F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in (lower, upper))
        found = found & a.between(least, greatest) & b.between(least, greatest) & (a < b)
    return F.coalesce(found, F.lit(False))


def grid_convention(cells: DataFrame) -> bool:
    """True when the grid counts longitude from 0 to 360.

    Runs one job over the ``lon`` column alone. A table of the grid's cells
    answers this without a look at the measurements.
    """
    west = cells.agg(F.min(C.LON)).first()[0]
    if west is None:
        raise ValueError(NO_OVERLAP)
    return west >= 0


def select_region(
    grid: DataFrame,
    region: Region,
    *,
    cells: DataFrame | None = None,
    nonnegative_lon: bool | None = None,
    strict: bool = False,
    allow_wrap: bool = False,
) -> DataFrame:
    """Rows of the grid inside the box, whatever order they come in.

    The bounds are brought to the grid's longitude convention, never the column,
    so the comparison reaches the file scan. Cells inside the box stay, also
    when their value is missing. ``cells`` (distinct ``lat``/``lon`` of the whole
    grid) or ``nonnegative_lon`` saves the pass that finds the convention.
    ``strict`` runs one job to reject a box without any cell. With ``allow_wrap``
    a box may reach across the seam of the grid's longitudes: it becomes two
    ranges of the column, both of which reach the scan.
    """
    region.validate()
    require_columns(grid, [C.LAT, C.LON], "grid")
    if nonnegative_lon is None:
        nonnegative_lon = grid_convention(cells if cells is not None else grid)
    ranges = region.longitudes(nonnegative_lon, allow_wrap=allow_wrap)
    within = reduce(or_, [F.col(C.LON).between(west, east) for west, east in ranges])
    inside = F.col(C.LAT).between(float(region.lat_min), float(region.lat_max)) & within
    if strict and (cells if cells is not None else grid).filter(inside).isEmpty():
        raise ValueError(NO_OVERLAP)
    return grid.filter(inside)


def _bins(lower: Column, upper: Column, width: float) -> Column:
    return F.explode(
        F.sequence(F.floor(lower / width).cast("int"), F.floor(upper / width).cast("int"))
    )


def _reason(nonnegative_lon: bool, allow_wrap: bool) -> Column:
    """Why a row of a regions table cannot be used; NULL if it can."""
    west = longitude_column("lon_min", nonnegative_lon)
    east = longitude_column("lon_max", nonnegative_lon)
    reason = F.when(~valid_region(), OUT_OF_RANGE)
    return reason if allow_wrap else reason.when(west >= east, ANTIMERIDIAN)


def _boxes(
    regions: DataFrame,
    name: str,
    extra: Sequence[str],
    nonnegative_lon: bool,
    allow_wrap: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Regions with bounds in the grid's convention; unusable ones fail the query,
    or else have no bounds.

    A box across the seam of the longitudes becomes two, one on each side.
    """
    bounds = [c for limits in LIMITS for c in limits[:2]]
    require_columns(regions, [name, *bounds, *extra], "regions")
    reason = _reason(nonnegative_lon, allow_wrap)
    start, end = (0.0, 360.0) if nonnegative_lon else (-180.0, 180.0)
    west = longitude_column("lon_min", nonnegative_lon)
    east = longitude_column("lon_max", nonnegative_lon)

    def part(low: Column | float, high: Column | float) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return F.struct(low.alias("_west"), high.alias("_east"))

    parts = (
        F.when(west < east, F.array(part(west, east)))
        .when(west == east, F.array(part(start, end)))
        .otherwise(F.array(part(start, east), part(west, end)))
    )
    refused = F.raise_error(reason) if strict else F.lit(None).cast("double")
    south = F.when(reason.isNotNull(), refused).otherwise(F.col("lat_min").cast("double"))
    boxes = regions.select(
        name, *extra, south.alias("_south"), F.col("lat_max").cast("double").alias("_north"), west.alias("_west"), east.alias("_east")
    )
    if not allow_wrap:
        return boxes
    return regions.select(
        name, *extra, south.alias("_south"), F.col("lat_max").cast("double").alias("_north"), F.explode(parts).alias("_part")
    ).select(name, *extra, "_south", "_north", "_part.*")


def quarantine_regions(
    regions: DataFrame,
    *,
    name: str = "region",
    nonnegative_lon: bool,
    cells: DataFrame | None = None,
    allow_wrap: bool = False,
    bin_degrees: float = 2.0,
) -> DataFrame:
    """The regions with a ``reason`` why they cannot be used, NULL where they can.

    What the jobs fail for is told here row by row, so that the others can go on:
    bounds that are missing, out of range or out of order, a box across the seam
    of the longitudes, and, with ``cells``, a region without any cell of the grid.
    Boxes that share a name are one region in that. Store the usable ones
    (``session.stored``) before a job takes them: Spark may test the bounds of a row
    before a filter on ``reason`` has dropped it.
    """
    bounds = [c for limits in LIMITS for c in limits[:2]]
    require_columns(regions, [name, *bounds], "regions")
    judged = regions.withColumn("reason", _reason(nonnegative_lon, allow_wrap))
    if cells is None:
        return judged
    # Unusable boxes have no bounds here, so they meet no cell.
    boxes = _boxes(regions, name, (), nonnegative_lon, allow_wrap, strict=False)
    places = _in_boxes(cells.select(C.LAT, C.LON).distinct(), boxes, bin_degrees)
    met = places.select(F.col(name).alias("_met")).distinct().withColumn("_some", F.lit(True))
    found = judged.join(met, judged[name].eqNullSafe(met["_met"]), "left")
    none = F.when(F.col("_some").isNull(), NO_OVERLAP)
    return found.select(*regions.columns, F.coalesce("reason", none).alias("reason"))


def _in_boxes(places: DataFrame, boxes: DataFrame, bin_degrees: float) -> DataFrame:
    """Rows of ``places`` with every box that holds them, by squares of the globe."""
    bins = boxes.withColumn("_row", _bins(F.col("_south"), F.col("_north"), bin_degrees))
    bins = bins.withColumn("_col", _bins(F.col("_west"), F.col("_east"), bin_degrees))
    placed = places.withColumns(
        {
            "_row": F.floor(F.col(C.LAT) / bin_degrees).cast("int"),
            "_col": F.floor(F.col(C.LON) / bin_degrees).cast("int"),
        }
    )
    return placed.join(bins, ["_row", "_col"]).filter(
        F.col(C.LAT).between(F.col("_south"), F.col("_north"))
        & F.col(C.LON).between(F.col("_west"), F.col("_east"))
    )


def assign_regions(
    grid: DataFrame,
    regions: DataFrame,
    *,
    name: str = "region",
    cells: DataFrame | None = None,
    nonnegative_lon: bool | None = None,
    bin_degrees: float = 2.0,
    extra: Sequence[str] = (),
    allow_wrap: bool = False,
) -> DataFrame:
    """Pair every grid row with each region of a table that contains its cell.

    With ``cells`` (distinct ``lat``/``lon`` of the whole grid) the regions are
    matched to that small table, and grid rows meet them by cell: as many keys
    as there are cells, and no false matches. Without it the rows themselves are
    matched: a region is listed under every ``bin_degrees`` square it touches
    (at most ``(180 / bin_degrees + 1) * (360 / bin_degrees + 1)``), a row looks
    up the square it lies in, and the exact bounds are tested. Invalid regions
    fail the query (``quarantine_regions`` tells them), and so does one across the
    seam of the longitudes unless ``allow_wrap`` lets it count as two boxes. A
    grid row in several regions appears once for each.
    """
    require_columns(grid, [C.LAT, C.LON], "grid")
    if nonnegative_lon is None:
        nonnegative_lon = grid_convention(cells if cells is not None else grid)
    boxes = _boxes(regions, name, extra, nonnegative_lon, allow_wrap)
    near = within_span(grid, boxes, "_south", "_north", "_west", "_east")
    if cells is None:
        matched = _in_boxes(near, boxes, bin_degrees)
    else:
        places = _in_boxes(cells.select(C.LAT, C.LON).distinct(), boxes, bin_degrees)
        matched = near.join(places.select(C.LAT, C.LON, name, *extra), [C.LAT, C.LON])
    return matched.select(name, *extra, *grid.columns)


def within_span(
    grid: DataFrame, table: DataFrame, south: str, north: str, west: str, east: str
) -> DataFrame:
    """Rows of the grid in the area that all rows of a small table span.

    The area is known before the grid is read, so its bounds reach the file scan,
    which join conditions cannot.
    """
    span = table.agg(
        F.min(south).alias("s"), F.max(north).alias("n"), F.min(west).alias("w"), F.max(east).alias("e")
    )
    bottom, top, left, right = [span.select(c).scalar() for c in ("s", "n", "w", "e")]
    return grid.filter(F.col(C.LAT).between(bottom, top) & F.col(C.LON).between(left, right))


def region_atoms(
    regions: DataFrame,
    cells: DataFrame,
    *,
    name: str = "region",
    nonnegative_lon: bool | None = None,
    bin_degrees: float = 2.0,
    allow_wrap: bool = False,
) -> DataFrame:
    """Cells by the set of regions that hold them: ``lat``, ``lon``, ``_regions``
    (array of structs of ``name``) and ``_atom``, which stands for the set.

    However many regions overlap, a cell has one atom, so measurements meet one
    row here and are reduced before they are counted for each region. The table
    is made at once and read from the scratch folder; it has a row for each cell
    in a region. Boxes of one region that overlap fail the job.
    """
    if nonnegative_lon is None:
        nonnegative_lon = grid_convention(cells)
    boxes = _boxes(regions, name, (), nonnegative_lon, allow_wrap)
    places = _in_boxes(cells.select(C.LAT, C.LON).distinct(), boxes, bin_degrees)
    held = F.col("_regions")
    once = raise_if(
        F.size(held) > F.size(F.array_distinct(held)), "boxes of one region overlap", F.xxhash64(held)
    )
    sets = places.groupBy(C.LAT, C.LON).agg(F.sort_array(F.collect_list(F.struct(name))).alias("_regions"))
    return stored(sets.withColumn("_atom", once), "atoms")


def regions_of_atoms(atoms: DataFrame) -> DataFrame:
    """``_atom`` with each of its regions; fails if two sets have one hash."""
    sets = atoms.groupBy("_atom").agg(F.min("_regions").alias("a"), F.max("_regions").alias("b"))
    one = raise_if(F.col("a") != F.col("b"), "two sets of regions have one hash", F.col("a"))
    return sets.select("_atom", F.explode(one).alias("_region")).select("_atom", "_region.*")


def region_cells(
    regions: DataFrame,
    cells: DataFrame,
    *,
    name: str = "region",
    nonnegative_lon: bool | None = None,
    bin_degrees: float = 2.0,
    allow_wrap: bool = False,
) -> DataFrame:
    """Number of grid cells in every region, 0 for one that lies off the grid."""
    if nonnegative_lon is None:
        nonnegative_lon = grid_convention(cells)
    boxes = _boxes(regions, name, (), nonnegative_lon, allow_wrap)
    places = _in_boxes(cells.select(C.LAT, C.LON).distinct(), boxes, bin_degrees)
    counted = places.groupBy(name).agg(F.count(F.lit(1)).alias("cells"))
    if allow_wrap:
        boxes = boxes.select(name).distinct()
    return boxes.join(counted, name, "left").select(
        name, F.coalesce("cells", F.lit(0)).alias("cells")
    )
