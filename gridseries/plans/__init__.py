"""Whole jobs made of the operators."""

from gridseries.plans.anomaly import (
    build_anomaly_table,
    load_regional_sst,
    preprocess_job,
    regional_series,
    series_of_regions,
)
from gridseries.plans.exploration import exploration_tables
from gridseries.plans.forecast import persistence_job

__all__ = [
    "build_anomaly_table",
    "exploration_tables",
    "load_regional_sst",
    "persistence_job",
    "preprocess_job",
    "regional_series",
    "series_of_regions",
]
