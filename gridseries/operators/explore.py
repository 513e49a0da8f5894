"""The numbers behind exploratory views of a series."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C
from gridseries.checks import raise_if, require_columns, require_series
from gridseries.functions import number
from gridseries.operators._keyed import attach, by_date, unrepeated
from gridseries.session import stored

# exp(-u*u/2) is exactly 0.0 in double precision beyond this distance.
KERNEL_REACH = 38.7
# Neighbouring places whose kernels are summed side by side.
KERNEL_BLOCK = 10
# Observations per block of the autocorrelation; a block also sees max_lags more.
ACF_BLOCK = 8192


def monthly_means(
    series: DataFrame, *, keys: Sequence[str] = (), value: str = C.SERIES_VALUE
) -> DataFrame:
    """Mean of the whole record per calendar month."""
    require_series(series, keys, value)
    return series.groupBy(*keys, F.month(C.DATE).alias("month")).agg(F.avg(number(value)).alias(value))


def _value_range(value: str) -> list[Column]:
    """Aggregates over the present values; infinite ends fail the query."""
    lowest, highest = F.min(value), F.max(value)
    endless = (F.abs(lowest) == F.lit(math.inf)) | (F.abs(highest) == F.lit(math.inf))
    return [
        F.count(value).alias("_n"),
        raise_if(endless, "the value range is not finite", lowest).alias("_lo"),
        highest.alias("_hi"),
        F.stddev_samp(value).alias("_sd"),
    ]


def _known(per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table of one row per key, written down when there are keys.

    Spark then plans the join by the table's true size: one that is small goes
    to the values, which stay where they are. An aggregate is taken for as large
    as its input, and the values would be dealt out by a handful of keys.
    """
    return stored(per_key, "per_key") if keys else per_key


def _carried(*columns: str) -> list[Column]:
    """Values that are the same in every row of a group."""
    return [F.any_value(c).alias(c) for c in columns]


def _by_place(
    sums: DataFrame, keys: Sequence[str], place: str, size: int, carried: Sequence[str]
) -> DataFrame:
    """List places 0 to ``size - 1`` of every key; ``_y`` is NULL where none was met.

    ``sums`` has one row per key and place, so a key gathers ``size`` rows at most.
    """
    met = F.map_from_entries(F.collect_list(F.struct(place, "_y")))
    return (
        sums.groupBy(*keys)
        .agg(met.alias("_met"), *_carried(*carried))
        .filter(F.size("_met") > 0)
        .withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        .withColumn("_y", F.try_element_at("_met", place))
    )


def histogram(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str = C.ANOMALY,
    bins: int = C.HISTOGRAM_BINS,
) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value.

    Bins are closed on the left, the last one on both sides; empty bins are
    listed. When all values are equal the range is widened by 0.5 either way.
    """
    require_columns(series, [*keys, value], "series")
    if bins < 1:
        raise ValueError(f"bins must be positive, got {bins!r}")
    present = series.select(*keys, number(value).alias("_x")).dropna(subset=["_x"])
    spread = present.groupBy(*keys).agg(*_value_range("_x"))
    margin = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    ends = spread.filter("_n > 0").select(
        *keys, (F.col("_lo") - margin).alias("_lo"), (F.col("_hi") + margin).alias("_hi")
    )

    def edge(i: Column) -> Column:
        width = (F.col("_hi") - F.col("_lo")) / bins
        return F.when(i >= bins, F.col("_hi")).otherwise(i * width + F.col("_lo"))

    # The quotient may miss an edge by rounding; the edges decide.
    position = (F.col("_x") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)
    guess = F.least(F.floor(position), F.lit(bins - 1))
    placed = attach(present, _known(ends, keys), keys).withColumn("_guess", guess)
    at = F.col("_guess")
    settled = (
        at
        - F.when(F.col("_x") < edge(at), 1).otherwise(0)
        + F.when((F.col("_x") >= edge(at + 1)) & (at < bins - 1), 1).otherwise(0)
    )
    counted = _by_place(
        placed.withColumn("bin", settled.cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("_y"), *_carried("_lo", "_hi")),
        keys,
        "bin",
        bins,
        ["_lo", "_hi"],
    )
    return counted.select(
        *keys,
        "bin",
        edge(F.col("bin")).alias("left_edge"),
        edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("_y", F.lit(0)).alias("count"),
    )


def density_curve(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str = C.ANOMALY,
    bins: int = C.HISTOGRAM_BINS,
    points: int = C.CURVE_POINTS,
) -> DataFrame:
    """Gaussian kernel density on the scale of :func:`histogram` counts.

    Scott bandwidth, evaluated at ``points`` places from the smallest to the
    largest value; a constant series has no curve. Each observation meets only
    the places where its kernel is not exactly zero: the bandwidth shrinks as
    data grow, so a long table visits ever fewer places per row. Sums are formed
    before anything is shuffled.
    """
    require_columns(series, [*keys, value], "series")
    if points < 2:
        raise ValueError(f"points must be at least 2, got {points!r}")
    present = series.select(*keys, number(value).alias("_x")).dropna(subset=["_x"])
    spread = present.groupBy(*keys).agg(*_value_range("_x"))
    bandwidth = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    shape = spread.filter("_n > 0").select(
        *keys,
        "_lo",
        "_hi",
        F.when((bandwidth > 0) & (F.col("_lo") < F.col("_hi")), bandwidth).alias("_h"),
        ((F.col("_hi") - F.col("_lo")) / (points - 1)).alias("_step"),
    )
    reach = F.col("_h") * KERNEL_REACH
    offset, step = F.col("_x") - F.col("_lo"), F.col("_step")
    nearest = F.greatest(F.ceil(F.try_divide(offset - reach, step)).cast("int"), F.lit(0))
    farthest = F.least(
        F.floor(F.try_divide(offset + reach, step)).cast("int"), F.lit(points - 1)
    )
    met = attach(present, _known(shape, keys), keys).filter("_h is not null")
    met = met.withColumns({"_from": nearest, "_to": farthest}).filter("_from <= _to")

    def block(place: str) -> Column:
        return F.floor(F.col(place) / KERNEL_BLOCK).cast("int")

    # One row per block of places it reaches, and the block's kernels side by
    # side: a tenth of the rows, and a tenth of the lookups in the aggregate.
    met = met.withColumn("_block", F.explode(F.sequence(block("_from"), block("_to"))))
    start = F.col("_block") * KERNEL_BLOCK * F.col("_step") + F.col("_lo")
    met = met.withColumns(
        {"_u": (start - F.col("_x")) / F.col("_h"), "_du": F.col("_step") / F.col("_h")}
    )
    kernels = []
    for i in range(KERNEL_BLOCK):
        u = F.col("_u") + F.col("_du") * i
        kernels.append(F.sum(F.exp(u * u * -0.5)))
    shape_columns = ["_lo", "_hi", "_h", "_step"]
    sums = (
        met.groupBy(*keys, "_block")
        .agg(F.array(*kernels).alias("_sums"), *_carried(*shape_columns))
        .select(*keys, "_block", *shape_columns, F.posexplode("_sums").alias("_at", "_y"))
        .withColumn("point", F.col("_block") * KERNEL_BLOCK + F.col("_at"))
        .filter(F.col("point") < points)
    )
    curve = _by_place(sums, keys, "point", points, shape_columns)

    def place(i: Column) -> Column:
        return F.when(i == points - 1, F.col("_hi")).otherwise(
            i * F.col("_step") + F.col("_lo")
        )

    bin_width = (F.col("_hi") - F.col("_lo")) / bins
    scale = bin_width / (F.col("_h") * math.sqrt(2 * math.pi))
    return curve.select(
        *keys,
        "point",
        place(F.col("point")).alias("x"),
        (scale * F.coalesce("_y", F.lit(0.0))).alias("density"),
    )


def autocorrelation(
    series: DataFrame,
    *,
    keys: Sequence[str] = (),
    value: str = C.ANOMALY,
    max_lags: int = C.MAX_LAGS,
    strict: bool = False,
) -> DataFrame:
    """Autocorrelation at lags 1 to ``min(max_lags, n // 2 - 1)``.

    Missing values are dropped first, so a lag counts observations, not days.
    Deviations from the mean of the series are summed over all pairs and divided
    by the sum of squares (the biased estimate); NULL for a constant series.

    The lag sums are taken on blocks of ``ACF_BLOCK`` neighbouring observations,
    each with the ``max_lags`` that follow it, so a task never holds more than
    one block in Python and a table of lagged pairs never exists. ``strict``
    fails the query for a series of fewer than three observations.
    """
    require_series(series, keys, value)
    if max_lags < 1:
        raise ValueError(f"max_lags must be positive, got {max_lags!r}")
    order, whole = by_date(keys), Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    if strict:
        n = raise_if(n < 3, "autocorrelation needs three observations or more", n)
    observed = (
        series.select(*keys, C.DATE, number(value).alias("_x"))
        .dropna(subset=["_x"])
        .select(
            *keys,
            C.DATE,
            (F.col("_x") - F.avg("_x").over(whole)).alias("_c"),
            F.lag(C.DATE).over(order).alias("_last_date"),
            (F.row_number().over(order) - 1).alias("_at"),
            n.alias("_n"),
        )
        .withColumn("_c", unrepeated("_last_date", F.col("_c")))
        .drop(C.DATE, "_last_date")
    )
    block = F.floor(F.col("_at") / ACF_BLOCK).cast("int")
    # A row also belongs to the earlier blocks whose last rows reach it.
    first = F.greatest(
        F.lit(0), F.floor((F.col("_at") - max_lags) / ACF_BLOCK).cast("int")
    )
    spread = observed.withColumn("_block", F.explode(F.sequence(first, block)))

    key_fields = [series.schema[k] for k in keys]
    result = T.StructType(
        [
            *key_fields,
            T.StructField("_n", T.LongType()),
            T.StructField("lag", T.IntegerType()),
            T.StructField("_sum", T.DoubleType()),
        ]
    )
    key_names, block_size = list(keys), ACF_BLOCK

    def lag_sums(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_at")
        c = pdf["_c"].to_numpy()
        own = int((pdf["_at"] < (pdf["_block"].iloc[0] + 1) * block_size).sum())
        lags = np.arange(0, min(max_lags, len(c) - 1) + 1)
        sums = [float(c[: min(own, len(c) - k)] @ c[k : k + min(own, len(c) - k)]) for k in lags]
        out = pd.DataFrame({"lag": lags.astype("int32"), "_sum": sums})
        out["_n"] = pdf["_n"].iloc[0]
        for k in key_names:
            out[k] = pdf[k].iloc[0]
        return out[[*key_names, "_n", "lag", "_sum"]]

    sums = (
        spread.groupBy(*keys, "_block")
        .applyInPandas(lag_sums, result)
        .groupBy(*keys, "lag")
        .agg(F.sum("_sum").alias("_sum"), F.max("_n").alias("_n"))
    )
    longest = F.least(F.lit(max_lags), F.floor(F.col("_n") / 2).cast("int") - 1)
    squares = F.max(F.when(F.col("lag") == 0, F.col("_sum"))).over(whole)
    return (
        sums.withColumn("acf", F.try_divide("_sum", squares))
        .filter((F.col("lag") > 0) & (F.col("lag") <= longest))
        .select(*keys, "lag", "acf", F.col("_n").alias("n"))
    )


def acf_band(acf: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``half_width``, the 95 % band around zero by Bartlett's formula.

    The variance at a lag grows with the squared autocorrelations before it;
    where those are NULL, so is the band.
    """
    require_columns(acf, [*keys, "lag", "acf", "n"], "acf")
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.when(F.col("lag") == 1, 0.0).otherwise(
        F.sum(F.col("acf") * F.col("acf")).over(before)
    )
    return acf.withColumn(
        "half_width", F.lit(C.NORMAL_95) * F.sqrt((squares * 2.0 + 1.0) / F.col("n"))
    )


def profile(series: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Per column: type, row count, non-null count; and the date range."""
    require_columns(series, [*keys, C.DATE], "series")
    fields = [f for f in series.schema.fields if f.name not in keys and f.name != C.DATE]
    counted = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(C.DATE).alias("first_date"),
        F.max(C.DATE).alias("last_date"),
        *[F.count(f"`{f.name}`").alias(f"_n{i}") for i, f in enumerate(fields)],
    )
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"_n{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counted.select(
        *keys, F.inline(columns), "row_count", "first_date", "last_date"
    )
