"""Readers: daily grid tables, the stored anomaly table, file listings."""

from gridseries.sources.buckets import read_series
from gridseries.sources.extent import grid_extent
from gridseries.sources.files import list_files
from gridseries.sources.grid import prepare_grid, read_grid
from gridseries.sources.tables import read_anomaly_table, read_exploration_table

__all__ = [
    "grid_extent",
    "list_files",
    "prepare_grid",
    "read_anomaly_table",
    "read_exploration_table",
    "read_grid",
    "read_series",
]
