"""Grids that grow: new measurements are reduced as they arrive."""

from gridseries.streaming.daily import daily_of_stream, stream_grid, stream_progress

__all__ = ["daily_of_stream", "stream_grid", "stream_progress"]
