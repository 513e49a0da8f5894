"""Writers: grid tables, result tables, metadata."""

from gridseries.sinks.buckets import write_series
from gridseries.sinks.tables import (
    metadata_text,
    write_cells,
    write_csv,
    write_grid,
    write_metadata,
)

__all__ = ["metadata_text", "write_cells", "write_csv", "write_grid", "write_metadata", "write_series"]
