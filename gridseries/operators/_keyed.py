"""Helpers shared by the keyed operators."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import raise_if


def by_date(keys: Sequence[str]) -> WindowSpec:
    """Rows of one series in date order."""
    return Window.partitionBy(*keys).orderBy(C.DATE)


def next_date(keys: Sequence[str]) -> Column:
    """Date of the following row of a series."""
    return F.lead(C.DATE).over(by_date(keys))


def unrepeated(neighbour: str, value: Column) -> Column:
    """``value``, unless the date in ``neighbour`` is the row's own date.

    Put on a column that a result depends on, this finds repeated dates in the
    pass that is made anyway.
    """
    same = F.col(neighbour) == F.col(C.DATE)
    return raise_if(same, "a date occurs twice in a series", value)


def days_until(following: str) -> Column:
    """Offsets of the row's date and of the days after it, up to the next row.

    Whole numbers rather than dates: a sequence of dates is computed by way of
    time stamps, which takes several times as long.
    """
    last = F.coalesce(F.datediff(following, C.DATE) - 1, F.lit(0))
    return F.explode(F.sequence(F.lit(0), unrepeated(following, last)))


def next_not_null(column: str, keys: Sequence[str]) -> Column:
    """The nearest later value that is not NULL.

    ``lead ... ignore nulls`` runs over the same ascending order as every other
    function of a series, so it adds no sort, and it moves one cursor forward
    instead of searching a frame again for each row.
    """
    partition = "partition by " + ", ".join(f"`{k}`" for k in keys) if keys else ""
    return F.expr(f"lead(`{column}`) ignore nulls over ({partition} order by `{C.DATE}`)")


def attach(frame: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-key table to every row of ``frame``.

    Without keys the table has one row and its values are read as scalar
    subqueries; with keys it is an equi-join whose strategy Spark picks from the
    sizes it sees.
    """
    if keys:
        return frame.join(per_key, list(keys), "left")
    return frame.withColumns({c: per_key.select(c).scalar() for c in per_key.columns})
