"""Values that results depend on, and the defaults of every operator."""

import datetime as dt

# --- Fixed values: formats, patterns and texts that outputs must carry -------
BASE_URL = (
    "https://www.ncei.noaa.gov/data/sea-surface-temperature-optimum-"
    "interpolation/v2.1/access/avhrr"
)
FILE_PREFIX = "oisst-avhrr-v02r01."
FILE_SUFFIX = ".nc"
FILE_PATTERN = "oisst-avhrr-v02r01.*.nc"
FIRST_AVAILABLE_DATE = dt.date(1981, 9, 1)
ACTIONS = ("downloaded", "skipped", "planned")
BASELINE_NAME = "one-day persistence"
TARGET_NAME = "sst anomaly (degrees Celsius)"
SPLIT_NAME = "final chronological fraction"
RANDOM_SEED = 42
# Two-sided 95 % quantile of the standard normal distribution.
NORMAL_95 = 1.959963984540054
# Column names of the stored tables.
DATE, LAT, LON, GRID_VALUE = "date", "lat", "lon", "sst"
SERIES_VALUE = "sst_celsius"
INTERPOLATED = "is_interpolated"
CLIMATOLOGY = "climatology_celsius"
ANOMALY = "anomaly_celsius"
OBSERVED = "observed_anomaly_celsius"
PREDICTED = "predicted_anomaly_celsius"
ERROR = "error_celsius"
MONTH_PARTITION = "ym"

# Defaults.
MIN_VALID_FRACTION = 0.8
MAX_GAP_DAYS = 3
REFERENCE_START = "1991-01-01"
REFERENCE_END = "2020-12-31"
TEST_FRACTION = 0.2
HISTOGRAM_BINS = 50
CURVE_POINTS = 200
MAX_LAGS = 365
# --- End of fixed values ----------------------------------------------------
