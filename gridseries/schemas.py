"""Schemas of the tables that pass between jobs, and the missing-value rule.

Only NULL means "missing" inside this library. Sources turn NaN into NULL once,
on the way in; infinities are ordinary values until the forecast metrics.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C

GRID = T.StructType(
    [
        T.StructField(C.DATE, T.DateType()),
        T.StructField(C.LAT, T.DoubleType()),
        T.StructField(C.LON, T.DoubleType()),
        T.StructField(C.GRID_VALUE, T.DoubleType()),
    ]
)

SERIES = T.StructType(
    [
        T.StructField(C.DATE, T.DateType()),
        T.StructField(C.SERIES_VALUE, T.DoubleType()),
    ]
)

ANOMALY_TABLE = T.StructType(
    [
        T.StructField(C.DATE, T.DateType()),
        T.StructField(C.SERIES_VALUE, T.DoubleType()),
        T.StructField(C.INTERPOLATED, T.BooleanType()),
        T.StructField(C.CLIMATOLOGY, T.DoubleType()),
        T.StructField(C.ANOMALY, T.DoubleType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField(C.DATE, T.DateType()),
        T.StructField(C.OBSERVED, T.DoubleType()),
        T.StructField(C.PREDICTED, T.DoubleType()),
        T.StructField(C.ERROR, T.DoubleType()),
    ]
)

REGIONS = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("lat_min", T.DoubleType()),
        T.StructField("lat_max", T.DoubleType()),
        T.StructField("lon_min", T.DoubleType()),
        T.StructField("lon_max", T.DoubleType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("baseline", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("split_method", T.StringType()),
        T.StructField("test_fraction", T.DoubleType()),
        T.StructField("test_start", T.StringType()),
        T.StructField("test_end", T.StringType()),
        T.StructField("random_seed", T.LongType()),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("n", T.LongType()),
                    T.StructField("mae", T.DoubleType()),
                    T.StructField("rmse", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def nan_to_null(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace NaN by NULL in the floating-point columns among ``columns``."""
    floating = {
        f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return frame.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in floating}
    )
