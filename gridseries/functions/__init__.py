"""Column expressions used by the operators; all of them stay in the JVM."""

from gridseries.functions.dates import (
    day_key,
    day_stamp,
    file_name,
    file_path,
    file_url,
    iso_date,
    month_stamp,
    parse_date,
)
from gridseries.functions.numeric import (
    cosine_weight,
    is_finite,
    line_through,
    longitude_column,
    longitude_value,
    number,
    root_mean_square,
)

__all__ = [
    "cosine_weight",
    "day_key",
    "day_stamp",
    "file_name",
    "file_path",
    "file_url",
    "is_finite",
    "iso_date",
    "line_through",
    "longitude_column",
    "longitude_value",
    "month_stamp",
    "number",
    "parse_date",
    "root_mean_square",
]
