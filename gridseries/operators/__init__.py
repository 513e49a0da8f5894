"""DataFrame-to-DataFrame operators.

Every operator takes ``keys``: the columns that tell series apart. Without keys
the input is one series. A series holds at most one row per calendar date, and
the operators that window over a series enforce this while they run, so the
rows behind one window partition never exceed the days of the record, however
large the table is.
"""

from gridseries.operators.calendar import (
    align_series,
    date_range,
    regularize,
    spanned_dates,
    union_frames,
)
from gridseries.operators.climatology import (
    calculate_climatology,
    map_seasonal_cycle,
    reference_period,
    seasonal_cycle,
    with_climatology,
)
from gridseries.operators.explore import (
    acf_band,
    autocorrelation,
    density_curve,
    histogram,
    monthly_means,
    profile,
)
from gridseries.operators.ingest import (
    count_actions,
    dates_of_files,
    missing_dates,
    plan_days,
    plan_downloads,
    with_file_keys,
)
from gridseries.operators.metrics import finite_pairs, regression_metrics
from gridseries.operators.persistence import (
    chronological_split,
    evaluate_persistence,
    forecast_metadata,
    metadata_of,
    persistence_predictions,
    predictions_of,
    scored_days,
)
from gridseries.operators.region import (
    Region,
    assign_regions,
    grid_convention,
    quarantine_regions,
    region_atoms,
    region_cells,
    select_region,
    valid_region,
)
from gridseries.operators.gaps import bracket_valid, regularize_and_fill
from gridseries.operators.spatial import (
    area_weighted_mean_sst,
    coverage_by_day,
    coverage_quality,
    daily_sums,
    grid_weight,
    masked,
    merged_words,
    sums_of_words,
    word_sums,
)

__all__ = [
    "Region",
    "acf_band",
    "align_series",
    "area_weighted_mean_sst",
    "assign_regions",
    "autocorrelation",
    "bracket_valid",
    "calculate_climatology",
    "chronological_split",
    "count_actions",
    "coverage_by_day",
    "coverage_quality",
    "daily_sums",
    "date_range",
    "dates_of_files",
    "density_curve",
    "evaluate_persistence",
    "finite_pairs",
    "forecast_metadata",
    "grid_convention",
    "grid_weight",
    "histogram",
    "map_seasonal_cycle",
    "masked",
    "merged_words",
    "metadata_of",
    "missing_dates",
    "monthly_means",
    "persistence_predictions",
    "plan_days",
    "plan_downloads",
    "predictions_of",
    "profile",
    "quarantine_regions",
    "reference_period",
    "region_atoms",
    "region_cells",
    "regression_metrics",
    "regularize",
    "regularize_and_fill",
    "scored_days",
    "seasonal_cycle",
    "select_region",
    "spanned_dates",
    "sums_of_words",
    "union_frames",
    "valid_region",
    "with_climatology",
    "with_file_keys",
    "word_sums",
]
