"""Every operator as a query over the given tables.

Floats are rounded to six digits and integers widened, so that results compare
with those of the SQL in ``workload.oracle``.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import constants as C
from gridseries import operators as ops
from gridseries import plans, schemas, sinks, sources, streaming
from gridseries.checks import duplicate_cells, duplicate_dates
from gridseries.functions import iso_date, longitude_column
from gridseries.plans.forecast import read_predictions
from gridseries.session import scratch_path
from workload import views

Query = Callable[[SparkSession, str], DataFrame]

REFERENCE = {"reference_start": "1995-01-01", "reference_end": "1999-12-31"}
NATION_BOX = ops.Region(29, 41, 114, 126)
SUPPLIER_BOX = ops.Region(31, 39, 115, 127)
_QUERIES: dict[str, Query] = {}


def _plain(frame: DataFrame) -> DataFrame:
    """Round doubles, widen integers."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def query(run: Query) -> Query:
    def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(run(spark, sf_dir))

    registered.__doc__ = run.__doc__
    _QUERIES[run.__name__] = registered
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- Calendar and ingestion ---------------------------------------------------


def _stored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.orders_by_day(spark, sf_dir).select("date")


@query
def gen_calendar(spark, sf_dir):
    """Every date of the period the orders span."""
    return ops.spanned_dates(_stored_dates(spark, sf_dir))


@query
def gen_file_keys(spark, sf_dir):
    """URL and path of the daily file of every order date."""
    return ops.with_file_keys(_stored_dates(spark, sf_dir).distinct(), output_dir="raw")


@query
def gen_parse_dates(spark, sf_dir):
    """Strict date parse of many spellings."""
    return views.date_texts(spark, sf_dir).select(
        "text", iso_date("text", on_error="null").alias("parsed")
    )


def _plan(spark, sf_dir, **options):
    stored = _stored_dates(spark, sf_dir)
    return ops.plan_days(ops.spanned_dates(stored), stored, output_dir="raw", **options)


@query
def ingest_plan(spark, sf_dir):
    """Fetch or skip each day, by the dates that have orders."""
    return _plan(spark, sf_dir)


@query
def ingest_counts(spark, sf_dir):
    """Days per action."""
    return ops.count_actions(_plan(spark, sf_dir))


@query
def ingest_counts_overwrite(spark, sf_dir):
    """Days per action when everything is fetched again."""
    return ops.count_actions(_plan(spark, sf_dir, overwrite=True))


@query
def ingest_counts_dry_run(spark, sf_dir):
    """Days per action of a dry run."""
    return ops.count_actions(_plan(spark, sf_dir, dry_run=True))


@query
def ingest_missing(spark, sf_dir):
    """Days of the period without orders."""
    wanted = ops.spanned_dates(_stored_dates(spark, sf_dir))
    return ops.missing_dates(wanted, _stored_dates(spark, sf_dir))


# --- Regions ------------------------------------------------------------------


@query
def region_valid(spark, sf_dir):
    """Bounds check on boxes made of the customers' balances."""
    balance = F.col("c_acctbal")
    boxes = views.table(spark, sf_dir, "customer").select(
        "c_custkey",
        (balance / 80 - 40).alias("lat_min"),
        (balance / 100 + F.col("c_nationkey") - 30).alias("lat_max"),
        (balance / 20 - 150).alias("lon_min"),
        (balance / 25).alias("lon_max"),
    )
    return boxes.select("c_custkey", ops.valid_region().alias("valid"))


@query
def lon_convert(spark, sf_dir):
    """Longitudes in both conventions."""
    value = F.col("c_acctbal") / 10 - 300
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey",
        longitude_column(value, True).alias("lon_0_360"),
        longitude_column(value, False).alias("lon_180_180"),
    )


@query
def grid_labels(spark, sf_dir):
    """Longitude convention and total weight of the supplier grid."""
    cells = views.supplier_cells(spark, sf_dir)
    weight = ops.grid_weight(cells)
    return weight.withColumn("nonnegative_lon", F.lit(ops.grid_convention(cells)))


@query
def region_box(spark, sf_dir):
    """Box selection on a grid that counts longitude from zero."""
    return ops.select_region(
        views.nation_grid(spark, sf_dir), NATION_BOX, cells=views.nation_cells(spark, sf_dir)
    )


@query
def region_box_lon180(spark, sf_dir):
    """The same box, given in 0..360, on a grid that runs from -180 to 180."""

    def shifted(frame):
        return frame.withColumn("lon", F.col("lon") - 240)

    return ops.select_region(
        shifted(views.nation_grid(spark, sf_dir)),
        ops.Region(29, 41, 234, 246),
        cells=shifted(views.nation_cells(spark, sf_dir)),
    )


def _in_regions(spark, sf_dir):
    return ops.assign_regions(
        views.nation_grid(spark, sf_dir),
        views.region_table(spark, sf_dir),
        cells=views.nation_cells(spark, sf_dir),
        nonnegative_lon=True,
    )


def _regions_series(spark, sf_dir):
    return plans.series_of_regions(
        views.nation_grid(spark, sf_dir),
        views.region_table(spark, sf_dir),
        min_valid_fraction=0.2,
        cells=views.nation_cells(spark, sf_dir),
        nonnegative_lon=True,
    )


@query
def regions_join(spark, sf_dir):
    """Grid rows of five overlapping boxes from a table."""
    return _in_regions(spark, sf_dir)


@query
def regions_mean(spark, sf_dir):
    """Weighted daily mean of each of the five boxes."""
    return _regions_series(spark, sf_dir).withColumnRenamed("sst_celsius", "sst")


@query
def regions_supplier(spark, sf_dir):
    """Weighted daily mean of a box for each nation, matched by way of the cells."""
    return plans.series_of_regions(
        views.supplier_grid(spark, sf_dir),
        views.customer_regions(spark, sf_dir),
        name="nation",
        min_valid_fraction=0.2,
        cells=views.supplier_cells(spark, sf_dir),
        nonnegative_lon=True,
    )


@query
def region_cells(spark, sf_dir):
    """Grid cells of every box, those off the grid with none."""
    return ops.region_cells(
        views.regions_and_others(spark, sf_dir),
        views.nation_cells(spark, sf_dir),
        nonnegative_lon=True,
    )


def _across_the_seam(frame):
    """Sixty degrees further east, where longitudes run from -180 to 180."""
    return frame.withColumn("lon", longitude_column(F.col("lon") + 60, False))


def _boxes_across_the_seam(spark, sf_dir):
    boxes = views.region_table(spark, sf_dir)
    return boxes.withColumns({c: F.col(c) + 60 for c in ("lon_min", "lon_max")})


@query
def region_wrap(spark, sf_dir):
    """A box from 174 degrees east to 174 degrees west."""
    return ops.select_region(
        _across_the_seam(views.nation_grid(spark, sf_dir)),
        ops.Region(29, 41, 174, 186),
        nonnegative_lon=False,
        allow_wrap=True,
    )


@query
def regions_wrap_mean(spark, sf_dir):
    """Weighted daily mean of five boxes, three of which lie across the seam."""
    series = plans.series_of_regions(
        _across_the_seam(views.nation_grid(spark, sf_dir)),
        _boxes_across_the_seam(spark, sf_dir),
        min_valid_fraction=0.2,
        cells=_across_the_seam(views.nation_cells(spark, sf_dir)),
        nonnegative_lon=False,
        allow_wrap=True,
    )
    return series.withColumnRenamed("sst_celsius", "sst")


@query
def regions_quarantined(spark, sf_dir):
    """Boxes made of the customers' balances, with the reason why one is unusable."""
    balance = F.col("c_acctbal")
    boxes = views.table(spark, sf_dir, "customer").select(
        "c_custkey",
        (balance / 80 - 40).alias("lat_min"),
        (balance / 100 + F.col("c_nationkey") - 30).alias("lat_max"),
        (balance / 20 - 150).alias("lon_min"),
        (balance / 25).alias("lon_max"),
    )
    found = ops.quarantine_regions(
        boxes, name="c_custkey", nonnegative_lon=True, cells=views.nation_cells(spark, sf_dir)
    )
    return found.select("c_custkey", "reason")


# --- Spatial means ------------------------------------------------------------


@query
def coverage_quality(spark, sf_dir):
    """Rows, distinct cells and covered share per day of rows whose cells repeat."""
    return ops.coverage_quality(views.supplier_rows(spark, sf_dir))


def _supplier_box(spark, sf_dir):
    cells = views.supplier_cells(spark, sf_dir)
    inside = ops.select_region(
        views.supplier_grid(spark, sf_dir), SUPPLIER_BOX, nonnegative_lon=True
    )
    return inside, ops.select_region(cells, SUPPLIER_BOX, nonnegative_lon=True)


@query
def weighted_mean(spark, sf_dir):
    """Cosine-weighted daily mean of a box of the supplier grid."""
    inside, cells = _supplier_box(spark, sf_dir)
    return ops.area_weighted_mean_sst(inside, min_valid_fraction=0.001, cells=cells)


@query
def valid_fraction(spark, sf_dir):
    """Valid weight and share of the grid's weight per day."""
    inside, cells = _supplier_box(spark, sf_dir)
    return ops.coverage_by_day(inside, cells=cells).select(
        "date", "valid_weight", "full_weight", "valid_fraction"
    )


@query
def coverage_mask(spark, sf_dir):
    """Daily mean, missing on days that cover too little of the box."""
    inside, cells = _supplier_box(spark, sf_dir)
    return ops.area_weighted_mean_sst(inside, min_valid_fraction=0.15, cells=cells)


# --- Regular calendars and gaps -----------------------------------------------


@query
def regularize(spark, sf_dir):
    """Full daily calendar of every priority's series."""
    return ops.regularize(views.priority_series(spark, sf_dir), keys=["series_id"])


@query
def asof_valid(spark, sf_dir):
    """Nearest valid day before and after each row."""
    around = ops.bracket_valid(views.priority_series(spark, sf_dir), keys=["series_id"])
    return around.drop("sst_celsius", "next_date")


def _filled(spark, sf_dir, limit):
    series = views.priority_series(spark, sf_dir)
    return ops.regularize_and_fill(series, keys=["series_id"], max_gap_days=limit)


@query
def fill_gap_0(spark, sf_dir):
    """Calendar without filling."""
    return _filled(spark, sf_dir, 0)


@query
def fill_gap_1(spark, sf_dir):
    """One day of each gap filled."""
    return _filled(spark, sf_dir, 1)


@query
def fill_gap_3(spark, sf_dir):
    """Up to three days of each gap filled."""
    return _filled(spark, sf_dir, 3)


@query
def fill_single(spark, sf_dir):
    """Filling of one series without keys."""
    return ops.regularize_and_fill(views.daily_series(spark, sf_dir))


@query
def fill_multi(spark, sf_dir):
    """Filling of a series per nation, with long gaps."""
    series = views.nation_series(spark, sf_dir)
    return ops.regularize_and_fill(series, keys=["nation"], max_gap_days=2)


@query
def align_series(spark, sf_dir):
    """Order and shipment series side by side."""
    shipped = (
        views.supplier_grid(spark, sf_dir).groupBy("date").agg(F.avg("sst").alias("shipped"))
    )
    ordered = views.daily_series(spark, sf_dir).withColumnRenamed("sst_celsius", "ordered")
    return ops.align_series(ordered, shipped)


@query
def union_periods(spark, sf_dir):
    """Two periods of the grid, each cut on its own, put together again."""
    grid = views.nation_grid(spark, sf_dir)
    early = grid.filter(F.col("date") < F.lit("1998-01-01").cast("date"))
    late = grid.filter(F.col("date") >= F.lit("1998-01-01").cast("date"))
    return ops.union_frames([early, late.select("sst", "lon", "lat", "date")])


# --- Climatology and anomalies ------------------------------------------------


@query
def ref_period(spark, sf_dir):
    """Valid values between two months, given as partial dates."""
    return ops.reference_period(
        views.daily_series(spark, sf_dir), reference_start="1995-03", reference_end="1999"
    )


@query
def clim_day(spark, sf_dir):
    """Mean per calendar day."""
    return ops.seasonal_cycle(views.daily_series(spark, sf_dir), **REFERENCE)


@query
def clim_month(spark, sf_dir):
    """Mean per calendar month and priority."""
    series = views.priority_series(spark, sf_dir)
    return ops.seasonal_cycle(series, keys=["series_id"], frequency="month", **REFERENCE)


@query
def clim_map(spark, sf_dir):
    """Cycle of 1995 mapped onto all dates; its missing seasons stay missing."""
    series = views.priority_series(spark, sf_dir)
    mapped, _ = ops.calculate_climatology(
        series, keys=["series_id"], reference_start="1995", reference_end="1995"
    )
    return mapped


@query
def clim_window(spark, sf_dir):
    """The same values computed in place."""
    series = views.priority_series(spark, sf_dir)
    return ops.with_climatology(
        series, keys=["series_id"], reference_start="1995", reference_end="1995"
    ).select("series_id", "date", "climatology_celsius")


@query
def anomaly_table(spark, sf_dir):
    """Anomaly table of one series."""
    return plans.build_anomaly_table(views.daily_series(spark, sf_dir), **REFERENCE)


@query
def anomaly_by_nation(spark, sf_dir):
    """Anomaly table of a series per nation."""
    series = views.nation_series(spark, sf_dir)
    return plans.build_anomaly_table(series, keys=["nation"], max_gap_days=2, **REFERENCE)


@query
def anomaly_monthly(spark, sf_dir):
    """Anomalies against monthly means."""
    series = views.priority_series(spark, sf_dir)
    return plans.build_anomaly_table(
        series, keys=["series_id"], climatology="month", **REFERENCE
    )


def _grid_anomaly(spark, sf_dir):
    series = plans.regional_series(
        views.supplier_grid(spark, sf_dir),
        SUPPLIER_BOX,
        min_valid_fraction=0.15,
        cells=views.supplier_cells(spark, sf_dir),
        nonnegative_lon=True,
    )
    return plans.build_anomaly_table(series, max_gap_days=1, **REFERENCE)


@query
def grid_to_anomaly(spark, sf_dir):
    """Grid, box, weighted mean, filling, climatology, anomaly."""
    return _grid_anomaly(spark, sf_dir)


# --- Persistence and metrics --------------------------------------------------


def _nation_anomaly(spark, sf_dir):
    series = views.nation_series(spark, sf_dir)
    return plans.build_anomaly_table(series, keys=["nation"], **REFERENCE)


@query
def persistence(spark, sf_dir):
    """Value of the day before for each calendar day."""
    return ops.persistence_predictions(
        views.priority_series(spark, sf_dir), keys=["series_id"], value="sst_celsius"
    )


@query
def chrono_split(spark, sf_dir):
    """Position in the record and membership in the final part."""
    series = views.priority_series(spark, sf_dir).select("series_id", "date")
    return ops.chronological_split(series, keys=["series_id"], test_fraction=0.3)


@query
def persistence_eval(spark, sf_dir):
    """Predictions on the final part of each nation's anomalies."""
    return ops.evaluate_persistence(_nation_anomaly(spark, sf_dir), keys=["nation"])[0]


def _flat(metadata):
    return metadata.select("*", "metrics.*").drop("metrics")


@query
def persistence_meta(spark, sf_dir):
    """Metadata of the forecast of one series."""
    return _flat(ops.evaluate_persistence(plans.build_anomaly_table(
        views.daily_series(spark, sf_dir), **REFERENCE
    ))[1])


@query
def persistence_meta_by_nation(spark, sf_dir):
    """Metadata of the forecast of every nation."""
    return _flat(ops.evaluate_persistence(_nation_anomaly(spark, sf_dir), keys=["nation"])[1])


@query
def forecast_status_by_key(spark, sf_dir):
    """Scored days of every customer's series, also where there are none."""
    series = views.customer_series(spark, sf_dir)
    scored = ops.scored_days(series, keys=["custkey"], value="sst_celsius")
    return _flat(ops.metadata_of(scored, keys=["custkey"])).select(
        "custkey", "n", "mae", "test_start", "test_end"
    )


@query
def grid_to_forecast(spark, sf_dir):
    """The whole chain from the grid to the forecast's metadata."""
    return _flat(ops.evaluate_persistence(_grid_anomaly(spark, sf_dir))[1])


@query
def regions_to_forecast(spark, sf_dir):
    """The whole chain for every region of a table at once."""
    table = plans.build_anomaly_table(
        _regions_series(spark, sf_dir), keys=["region"], **REFERENCE
    )
    return _flat(ops.evaluate_persistence(table, keys=["region"])[1])


@query
def forecast_of_stored(spark, sf_dir):
    """Metadata of the forecast of every nation, from a table stored by nation."""
    path = scratch_path(spark, "series")
    sinks.write_series(_nation_anomaly(spark, sf_dir), path, keys=["nation"])
    table = sources.read_anomaly_table(spark, path, keys=["nation"], format="series")
    return _flat(ops.evaluate_persistence(table, keys=["nation"])[1])


@query
def finite_pairs(spark, sf_dir):
    """Pairs where both values are finite."""
    return ops.finite_pairs(views.forecast_pairs(spark, sf_dir))


@query
def metrics(spark, sf_dir):
    """Metrics over all pairs."""
    return ops.regression_metrics(views.forecast_pairs(spark, sf_dir))


@query
def metrics_by_type(spark, sf_dir):
    """Metrics per event type."""
    return ops.regression_metrics(views.forecast_pairs(spark, sf_dir), keys=["event_type"])


# --- Exploration --------------------------------------------------------------


def _anomaly(spark, sf_dir):
    return plans.build_anomaly_table(views.daily_series(spark, sf_dir), **REFERENCE)


@query
def monthly_means(spark, sf_dir):
    """Mean per month over the whole record."""
    return ops.monthly_means(views.priority_series(spark, sf_dir), keys=["series_id"])


@query
def histogram50(spark, sf_dir):
    """Distribution of the anomalies of one series."""
    return ops.histogram(_anomaly(spark, sf_dir))


@query
def histogram_orders(spark, sf_dir):
    """Distribution of all order values per priority."""
    orders = views.orders_by_day(spark, sf_dir)
    return ops.histogram(orders, keys=["series_id"], value="sst_celsius", bins=40)


@query
def kde200(spark, sf_dir):
    """Density curve of the anomalies of one series."""
    return ops.density_curve(_anomaly(spark, sf_dir))


@query
def kde_orders(spark, sf_dir):
    """Density curve of all order prices per status."""
    orders = views.orders_by_day(spark, sf_dir).withColumn("price", F.ln("o_totalprice"))
    return ops.density_curve(orders, keys=["o_orderstatus"], value="price")


@query
def acf(spark, sf_dir):
    """Autocorrelation of the anomalies of one series."""
    return ops.autocorrelation(_anomaly(spark, sf_dir))


@query
def acf_by_nation(spark, sf_dir):
    """Autocorrelation and its band for every nation."""
    found = ops.autocorrelation(_nation_anomaly(spark, sf_dir), keys=["nation"])
    return ops.acf_band(found, keys=["nation"])


@query
def acf_band(spark, sf_dir):
    """Autocorrelation with its band for one series."""
    return ops.acf_band(ops.autocorrelation(_anomaly(spark, sf_dir)))


@query
def profile(spark, sf_dir):
    """Row counts, types and period of the anomaly table."""
    return ops.profile(_anomaly(spark, sf_dir))


@query
def exploration_tables(spark, sf_dir):
    """All exploratory tables of one series, one below the other."""
    tables = plans.exploration_tables(_anomaly(spark, sf_dir))
    names = ["sst_celsius", "is_interpolated", "climatology_celsius", "anomaly_celsius"]
    column = F.array_position(F.array(*map(F.lit, names)), F.col("column"))
    places = {
        "profile": (column, "non_null"),
        "sst": (F.unix_date("date"), "sst_celsius"),
        "anomaly": (F.unix_date("date"), "anomaly_celsius"),
        "monthly_means": (F.col("month"), "sst_celsius"),
        "histogram": (F.col("bin"), "count"),
        "density": (F.col("point"), "density"),
        "autocorrelation": (F.col("lag"), "acf"),
    }
    return ops.union_frames(
        [
            tables[view].select(
                F.lit(view).alias("view"),
                place.cast("bigint").alias("place"),
                F.col(value).cast("double").alias("value"),
            )
            for view, (place, value) in places.items()
        ]
    )


@query
def dup_dates(spark, sf_dir):
    """Dates that repeat within a priority of the raw orders."""
    return duplicate_dates(views.orders_by_day(spark, sf_dir), keys=["series_id"])


@query
def dup_cells(spark, sf_dir):
    """Cells that repeat within a ship date of the raw line items."""
    cells = views.table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), *views._supplier_cell()
    )
    return duplicate_cells(cells)


# --- Files --------------------------------------------------------------------


@query
def grid_files(spark, sf_dir):
    """Grid written as monthly files, found again and read for two years."""
    path = scratch_path(spark, "grid")
    sinks.write_grid(views.nation_grid(spark, sf_dir), path)
    return sources.read_grid(spark, path, start="1996-02-01", end="1998-01-15")


@query
def grid_file_months(spark, sf_dir):
    """Months found in the file listing of a written grid."""
    path = scratch_path(spark, "grid")
    sinks.write_grid(views.nation_grid(spark, sf_dir), path)
    files = sources.list_files(spark, path, "*.parquet")
    month = F.regexp_extract("path", r"/ym=([0-9]{6})/", 1)
    return files.select(month.alias("ym")).distinct()


def _streamed(spark, sf_dir):
    """A grid that arrives in two parts, the second with rows of all days."""
    source, path = scratch_path(spark, "arriving"), scratch_path(spark, "streamed")
    inside, cells = _supplier_box(spark, sf_dir)
    later = (F.month("date") % 2 == 0) & (F.col("lat") >= 34)
    for part in (inside.filter(~later), inside.filter(later)):
        sinks.write_grid(part, source, mode="append")
        streaming.stream_grid(spark, source, path, cells=cells)
    return path


@query
def grid_streamed(spark, sf_dir):
    """Weighted daily mean of a box whose rows were streamed in two parts."""
    found = streaming.daily_of_stream(spark, _streamed(spark, sf_dir))
    return ops.masked(found, min_valid_fraction=0.15)


@query
def grid_stream_late(spark, sf_dir):
    """Rows of each part of the stream, and how many of them came late."""
    progress = streaming.stream_progress(spark, _streamed(spark, sf_dir))
    return progress.select("batch", "rows", "late_rows")


@query
def grid_extent(spark, sf_dir):
    """Rows and ends of a written grid, from its file footers."""
    path = scratch_path(spark, "grid")
    sinks.write_grid(views.nation_grid(spark, sf_dir), path)
    return sources.grid_extent(spark, path)


@query
def ingest_listing(spark, sf_dir):
    """Fetch or skip each day, by the daily files that a listing finds."""
    path = scratch_path(spark, "daily")
    days = views.orders_by_day(spark, sf_dir)
    name = F.concat(F.lit(C.FILE_PREFIX), F.date_format("date", "yyyyMMdd"), F.lit(C.FILE_SUFFIX))
    daily = days.groupBy("date").agg(F.avg("sst_celsius").alias("sst")).withColumn("file", name)
    daily.repartition("file").write.partitionBy("file").parquet(path)
    found = ops.dates_of_files(sources.list_files(spark, path, "*.parquet"))
    return ops.plan_days(ops.spanned_dates(_stored_dates(spark, sf_dir)), found, output_dir="raw")


@query
def grid_listing(spark, sf_dir):
    """Months in the order in which the listing of a written grid shows them."""
    path = scratch_path(spark, "grid")
    sinks.write_grid(views.nation_grid(spark, sf_dir), path)
    listed = sources.list_files(spark, path, "*.parquet").select(
        F.regexp_extract("path", r"/ym=([0-9]{6})/", 1).alias("ym"),
        F.monotonically_increasing_id().alias("place"),
    )
    months = listed.groupBy("ym").agg(F.min("place").alias("place"))
    return months.select("ym", F.row_number().over(Window.orderBy("place")).alias("position"))


@query
def grid_time_column(spark, sf_dir):
    """A grid whose days come as time stamps, brought to the common columns."""
    raw = views.nation_grid(spark, sf_dir).select(
        F.timestamp_seconds(F.unix_date("date") * 86400 + 43200).alias("time"),
        F.col("lat").cast("float").alias("lat"),
        F.col("lon").cast("float").alias("lon"),
        F.lit(0.0).alias("zlev"),
        "sst",
    )
    return sources.prepare_grid(raw, strict=True)


@query
def anomaly_csv(spark, sf_dir):
    """Grid files to anomaly CSV by the job, read back."""
    grid_path, table_path = scratch_path(spark, "grid"), scratch_path(spark, "anomaly")
    cells_path = scratch_path(spark, "cells")
    sinks.write_grid(views.supplier_grid(spark, sf_dir), grid_path)
    sinks.write_cells(views.supplier_cells(spark, sf_dir), cells_path)
    plans.preprocess_job(
        spark,
        grid_path,
        table_path,
        region=SUPPLIER_BOX,
        max_gap_days=1,
        min_valid_fraction=0.15,
        cells=spark.read.parquet(cells_path),
        climatology_start=REFERENCE["reference_start"],
        climatology_end=REFERENCE["reference_end"],
    )
    return sources.read_exploration_table(spark, table_path)


def _forecast_files(spark, sf_dir):
    table_path = scratch_path(spark, "anomaly")
    sinks.write_csv(_nation_anomaly(spark, sf_dir), table_path, keys=["nation"])
    paths = scratch_path(spark, "predictions"), scratch_path(spark, "metadata")
    plans.persistence_job(spark, table_path, *paths, keys=["nation"], strict=False)
    return paths


@query
def predictions_csv(spark, sf_dir):
    """Predictions written by the forecast job, read back."""
    predictions, _ = _forecast_files(spark, sf_dir)
    return read_predictions(spark, predictions, keys=["nation"]).withColumn(
        "nation", F.col("nation").cast("bigint")
    )


@query
def metadata_by_nation_json(spark, sf_dir):
    """Metadata of every nation written as JSON lines, read back."""
    _, metadata = _forecast_files(spark, sf_dir)
    schema = T.StructType([T.StructField("nation", T.LongType()), *schemas.METADATA.fields])
    lines = spark.read.option("prefersDecimal", False).json(metadata).select(
        F.col("nation").cast("bigint").alias("nation"), *[f.name for f in schemas.METADATA]
    )
    return _flat(lines.to(schema))


@query
def metadata_json(spark, sf_dir):
    """Metadata of one series written as one indented JSON object, read back."""
    table_path = scratch_path(spark, "anomaly")
    sinks.write_csv(_anomaly(spark, sf_dir), table_path)
    paths = scratch_path(spark, "predictions"), scratch_path(spark, "metadata")
    plans.persistence_job(spark, table_path, *paths)
    return _flat(spark.read.schema(schemas.METADATA).json(paths[1], multiLine=True))
