"""Edges and errors."""

import datetime as dt
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridseries import checks
from gridseries import operators as ops
from gridseries import plans
from gridseries.functions import iso_date, longitude_column, longitude_value, parse_date
from gridseries.operators.climatology import period_bounds
from tests.helpers import by_day, day, grid, run_of_days, series

# --- Arguments ----------------------------------------------------------------


@pytest.mark.parametrize("value", [0, -0.1, 1.01, math.nan])
def test_coverage_threshold_range(spark, value):
    with pytest.raises(ValueError):
        ops.area_weighted_mean_sst(grid(spark, [("2000-01-01", 0, 0, 1)]), min_valid_fraction=value)


def test_other_argument_ranges(spark):
    frame = series(spark, {"2000-01-01": 1})
    with pytest.raises(ValueError):
        ops.regularize_and_fill(frame, max_gap_days=-1)
    with pytest.raises(ValueError):
        ops.seasonal_cycle(frame, frequency="week")
    for fraction in (0, 1, -1, math.nan):
        with pytest.raises(ValueError):
            ops.evaluate_persistence(frame, value="sst_celsius", test_fraction=fraction)
    with pytest.raises(ValueError, match="missing columns.*anomaly_celsius"):
        ops.evaluate_persistence(frame)
    with pytest.raises(TypeError):
        ops.regularize(frame.withColumn("date", F.col("date").cast("timestamp")))


# --- Dates --------------------------------------------------------------------


def test_parse_date():
    assert parse_date("2020-02-29") == parse_date("2020-2-29") == day("2020-02-29")
    for text in ("2020", "2020-13-01", "2021-02-29", "20200101", " 2020-01-01", "0000-01-01", ""):
        with pytest.raises(ValueError, match="is not a date"):
            parse_date(text)


def test_iso_date_column(spark):
    texts = ["2020-02-29", "2020-2-9", "2021-02-29", "2020", "20200101", " 2020-01-01", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in frame.select(iso_date("t", on_error="null").alias("d")).collect()]
    assert got == [day("2020-02-29"), day("2020-02-09"), None, None, None, None, None]
    with pytest.raises(PySparkException, match="2021-02-29"):
        frame.filter("t like '2021%'").select(iso_date("t").alias("d")).collect()


def test_period_bounds():
    assert period_bounds("1991", "2020") == (day("1991-01-01"), day("2020-12-31"))
    assert period_bounds("1991-03", "1992-02") == (day("1991-03-01"), day("1992-02-29"))
    assert period_bounds("1991-03-05", dt.date(1992, 2, 1)) == (day("1991-03-05"), day("1992-02-01"))


# --- Regions ------------------------------------------------------------------


@pytest.mark.parametrize(
    "box",
    [
        (-91, 0, 0, 10), (0, 91, 0, 10), (5, 5, 0, 10), (6, 5, 0, 10), (0, 5, -181, 10),
        (0, 5, 0, 361), (0, 5, 10, 10), (math.nan, 5, 0, 10), (0, 5, 0, math.nan),
    ],
)
def test_region_bounds(spark, box):
    with pytest.raises(ValueError):
        ops.Region(*box).validate()
    names = ["lat_min", "lat_max", "lon_min", "lon_max"]
    frame = spark.createDataFrame([tuple(float(x) for x in box)], names)
    assert frame.select(ops.valid_region().alias("ok")).first().ok is False


def test_region_edges_are_valid():
    ops.Region(-90, 90, -180, 360).validate()
    assert ops.Region() == ops.Region(31, 39, 117, 127)


def test_longitude_conventions(spark):
    values = [-180.0, -10.0, 0.0, 117.0, 180.0, 350.0, 360.0]
    assert [longitude_value(v, True) for v in values] == [180, 350, 0, 117, 180, 350, 0]
    assert [longitude_value(v, False) for v in values] == [-180, -10, 0, 117, -180, -10, 0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for flag in (True, False):
        got = [r.x for r in frame.select(longitude_column("v", flag).alias("x")).collect()]
        assert got == [longitude_value(v, flag) for v in values]


def test_box_on_either_convention(spark):
    east = spark.createDataFrame([(0.0, 230.0), (0.0, 240.0), (0.0, 10.0)], "lat double, lon double")
    west = spark.createDataFrame([(0.0, -130.0), (0.0, -120.0), (0.0, 10.0)], "lat double, lon double")
    for region in (ops.Region(-1, 1, 225, 235), ops.Region(-1, 1, -135, -125)):
        assert [r.lon for r in ops.select_region(east, region).collect()] == [230.0]
        assert [r.lon for r in ops.select_region(west, region).collect()] == [-130.0]


@pytest.mark.parametrize(
    "bounds, nonnegative",
    [((-10, 10), True), ((0, 360), True), ((-180, 180), True), ((170, 190), False), ((100, 180), False)],
)
def test_boxes_over_the_antimeridian_are_rejected(spark, bounds, nonnegative):
    cells = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    with pytest.raises(ValueError, match="antimeridian"):
        ops.select_region(cells, ops.Region(-5, 5, *bounds), nonnegative_lon=nonnegative)


def test_box_off_the_grid(spark):
    cells = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    assert ops.select_region(cells, ops.Region()).isEmpty()
    with pytest.raises(ValueError, match="no cell"):
        ops.select_region(cells, ops.Region(), strict=True)
    with pytest.raises(ValueError):
        ops.select_region(cells.drop("lon"), ops.Region())


def test_box_keeps_missing_cells_and_its_edges(spark):
    frame = grid(spark, [("2000-01-01", a, 120, None) for a in (30.9, 31, 39, 39.1)])
    assert {r.lat for r in ops.select_region(frame, ops.Region()).collect()} == {31.0, 39.0}


def test_regions_table(spark):
    cells = spark.createDataFrame(
        [(float(a), float(o)) for a in range(-90, 91, 7) for o in range(0, 360, 11)],
        "lat double, lon double",
    )
    boxes = {
        "whole": (-90.0, 90.0, 0.0, 359.0), "edge": (-83.0, -76.0, 0.0, 11.0),
        "west": (-20.0, 20.0, -170.0, -100.0), "point": (0.5, 1.5, 10.5, 11.5),
    }
    frame = spark.createDataFrame(
        [(k, *v) for k, v in boxes.items()],
        "region string, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    for width in (1.0, 5.0, 400.0):
        got = ops.assign_regions(cells, frame, bin_degrees=width).collect()
        assert len(got) == len(set(got))
        for name, box in boxes.items():
            alone = ops.select_region(cells, ops.Region(*box)).collect()
            assert {(r.lat, r.lon) for r in got if r.region == name} == {tuple(r) for r in alone}
    bad = frame.filter("region = 'edge'").withColumn("lat_max", F.lit(-84.0))
    # Raised in a subquery, which Spark does not turn into an error of its own.
    with pytest.raises((PySparkException, Py4JJavaError), match="out of order"):
        ops.assign_regions(cells, frame.union(bad)).collect()


# --- Spatial mean -------------------------------------------------------------


def test_full_coverage_meets_a_threshold_of_one(spark):
    lats, lons = [x * 0.25 + 31.125 for x in range(32)], [x * 0.25 + 117.125 for x in range(40)]
    rows = [("2000-01-01", a, o, a + o) for a in lats for o in lons]
    rows += [("2000-01-02", a, o, None if (a, o) == (lats[0], lons[0]) else 1) for a in lats for o in lons]
    frame = grid(spark, rows)
    shares = by_day(ops.coverage_by_day(frame), "valid_fraction")
    assert shares["2000-01-01"] == 1.0 and shares["2000-01-02"] < 1.0
    means = by_day(ops.area_weighted_mean_sst(frame, min_valid_fraction=1), "sst")
    weights = [math.cos(math.radians(a)) for a in lats for _ in lons]
    values = [a + o for a in lats for o in lons]
    expected = sum(w * v for w, v in zip(weights, values)) / sum(weights)
    assert means["2000-01-01"] == pytest.approx(expected)
    assert means["2000-01-02"] is None


def test_grid_labels_come_from_all_dates_or_from_cells(spark):
    frame = grid(
        spark, [("2000-01-01", 0, 10, 4), ("2000-01-01", 60, 20, 1), ("2000-01-02", 0, 10, 7)]
    )
    # Two latitudes by two longitudes, weights 1 and 1/2: three in all.
    shares = by_day(ops.coverage_by_day(frame), "valid_fraction")
    assert shares == {"2000-01-01": pytest.approx(0.5), "2000-01-02": pytest.approx(1 / 3)}
    cells = spark.createDataFrame(
        [(a, o) for a in (0.0, 60.0) for o in (10.0, 20.0, 30.0)], "lat double, lon double"
    )
    shares = by_day(ops.coverage_by_day(frame, cells=cells), "valid_fraction")
    assert shares["2000-01-02"] == pytest.approx(1 / 4.5)


def test_repeated_cells_are_found(spark):
    frame = grid(spark, [("2000-01-01", 0, 10, 4), ("2000-01-01", 0, 10, 5), ("2000-01-02", 0, 10, 5)])
    with pytest.raises(PySparkException, match="occurs twice"):
        ops.area_weighted_mean_sst(frame).collect()
    with pytest.raises(ValueError, match="occurs twice"):
        checks.assert_unique_cells(frame)
    checks.assert_unique_cells(frame.filter("date = '2000-01-02'"))


def test_nan_is_missing_in_a_grid(spark):
    frame = grid(spark, [("2000-01-01", 0, 10, math.nan), ("2000-01-01", 0, 20, 3)])
    row = ops.coverage_by_day(frame).first()
    assert row["mean"] == 3.0 and row.valid_fraction == pytest.approx(0.5)


# --- Calendars and gaps -------------------------------------------------------


def test_edges_of_a_series_stay_missing(spark):
    frame = series(
        spark,
        {"2000-01-01": None, "2000-01-03": 1, "2000-01-05": 3, "2000-01-06": math.nan, "2000-01-08": None},
    )
    got = by_day(ops.regularize_and_fill(frame), "sst_celsius")
    assert list(got) and [got[f"2000-01-0{i}"] for i in range(1, 9)] == [
        None, None, 1.0, 2.0, 3.0, None, None, None,
    ]


def test_series_without_values_keeps_its_calendar(spark):
    frame = series(spark, {"2000-01-01": None, "2000-01-04": None})
    rows = ops.regularize_and_fill(frame).collect()
    assert [r.sst_celsius for r in rows] == [None] * 4
    assert not any(r.is_interpolated for r in rows)


def test_infinite_values_are_values(spark):
    inf = math.inf
    frame = series(
        spark,
        {"2000-01-01": 1, "2000-01-03": inf, "2000-01-05": inf, "2000-01-07": 2, "2000-01-09": -inf, "2000-01-11": inf},
    )
    got = by_day(ops.regularize_and_fill(frame), "sst_celsius")
    assert [got[f"2000-01-{i:02d}"] for i in (2, 4, 6, 8)] == [inf, inf, inf, -inf]
    assert got["2000-01-10"] is None


@pytest.mark.parametrize("limit", [0, 2])
def test_repeated_dates_fail(spark, limit):
    frame = series(spark, {"2000-01-01": 1, "2000-01-03": 2})
    twice = frame.union(frame.filter("date = '2000-01-03'").withColumn("sst_celsius", F.lit(None)))
    with pytest.raises(PySparkException, match="occurs twice"):
        ops.regularize_and_fill(twice, max_gap_days=limit).collect()
    for plan in (
        ops.persistence_predictions(twice, value="sst_celsius"),
        ops.evaluate_persistence(twice, value="sst_celsius")[0],
    ):
        with pytest.raises(PySparkException, match="occurs twice"):
            plan.collect()
    with pytest.raises(ValueError, match="occurs twice"):
        checks.assert_unique_dates(twice)
    checks.assert_unique_dates(frame)


def test_align_and_union(spark):
    left = series(spark, {"2000-01-01": 1, "2000-01-02": 2}, "a")
    right = series(spark, {"2000-01-02": 3, "2000-01-03": 4}, "b")
    rows = {str(r.date): (r.a, r.b) for r in ops.align_series(left, right).collect()}
    assert rows == {"2000-01-01": (1, None), "2000-01-02": (2, 3), "2000-01-03": (None, 4)}
    assert ops.union_frames([left, left.select("a", "date")]).count() == 4
    with pytest.raises(ValueError):
        ops.union_frames([])


# --- Climatology --------------------------------------------------------------


def test_leap_day_has_a_season_of_its_own(spark):
    frame = series(
        spark, {"1996-02-29": 4, "1997-03-01": 8, "2000-02-29": 6, "2024-02-29": 5, "2024-03-01": 9}
    )
    table = ops.with_climatology(frame, reference_start="1996", reference_end="2000")
    got = by_day(table, "climatology_celsius")
    assert got["2024-02-29"] == 5.0 and got["2024-03-01"] == 8.0
    no_leap = ops.with_climatology(frame, reference_start="1997", reference_end="1997")
    assert by_day(no_leap, "climatology_celsius")["2024-02-29"] is None
    cycle = ops.seasonal_cycle(frame, reference_start="1996", reference_end="2000")
    assert {r.season for r in cycle.collect()} == {"02-29", "03-01"}


def test_empty_reference_period(spark):
    frame = series(spark, {"2021-01-01": 1, "1995-01-01": None})
    for bounds in (("1991-01-01", "2020-12-31"), ("2022-01-01", "2020-01-01")):
        options = dict(zip(("reference_start", "reference_end"), bounds))
        with pytest.raises(ValueError, match="reference period"):
            ops.calculate_climatology(frame, strict=True, **options)
        with pytest.raises(PySparkException, match="reference period"):
            plans.build_anomaly_table(frame, strict=True, **options).collect()
        lenient = plans.build_anomaly_table(frame, **options)
        assert lenient.filter("anomaly_celsius is not null").isEmpty()


# --- Forecast -----------------------------------------------------------------


def test_short_and_empty_records(spark):
    one = series(spark, {"2020-01-01": 1}, "anomaly_celsius")
    with pytest.raises(PySparkException, match="two days or more"):
        ops.evaluate_persistence(one, strict=True)[0].collect()
    gap = series(spark, {"2020-01-01": 1, "2020-01-02": 2, "2020-01-05": 3}, "anomaly_celsius")
    test, metadata = ops.evaluate_persistence(gap, strict=True)
    assert test.isEmpty()
    with pytest.raises(PySparkException, match="no pair"):
        metadata.collect()


def test_infinite_error_stays_in_the_table_but_not_in_the_metrics(spark):
    frame = series(spark, run_of_days("2020-01-01", [0, 1, math.inf, 3, 4.5]), "anomaly_celsius")
    test, metadata = ops.evaluate_persistence(frame, test_fraction=0.9)
    assert test.count() == 4
    metrics = metadata.first().metrics
    assert (metrics.n, metrics.mae) == (2, 1.25)


def test_split_truncates_in_double_arithmetic(spark):
    frame = series(spark, run_of_days("2020-01-01", range(10)), "anomaly_celsius")
    split = ops.chronological_split(frame, test_fraction=0.9)
    assert split.filter("is_test").count() == 9
    assert {r.days for r in split.collect()} == {10}


def test_no_finite_pairs(spark):
    frame = spark.createDataFrame([(None, 1.0)], "observed double, predicted double")
    assert ops.regression_metrics(frame).first().n == 0
    with pytest.raises(PySparkException, match="no pair of finite"):
        ops.regression_metrics(frame, strict=True).collect()


# --- Exploration --------------------------------------------------------------


def test_constant_values(spark):
    frame = series(spark, run_of_days("2020-01-01", [5] * 8), "anomaly_celsius")
    bars = sorted(ops.histogram(frame).collect(), key=lambda r: r.bin)
    assert len(bars) == 50 and sum(r["count"] for r in bars) == 8
    assert (bars[0].left_edge, bars[-1].right_edge) == (4.5, 5.5)
    assert bars[25]["count"] == 8
    assert ops.density_curve(frame).isEmpty()
    assert [r.acf for r in ops.autocorrelation(frame).collect()] == [None] * 3


def test_infinite_range(spark):
    frame = series(spark, {"2020-01-01": 1, "2020-01-02": math.inf}, "anomaly_celsius")
    with pytest.raises((PySparkException, Py4JJavaError), match="not finite"):
        ops.histogram(frame).collect()


def test_autocorrelation_needs_three_values(spark):
    two = series(spark, {"2020-01-01": 1, "2020-01-02": 2, "2020-01-03": None}, "anomaly_celsius")
    with pytest.raises(PySparkException, match="three"):
        ops.autocorrelation(two, strict=True).collect()
    three = series(spark, run_of_days("2020-01-01", [1, 2, 4]), "anomaly_celsius")
    assert ops.autocorrelation(three, strict=True).isEmpty()


def test_nothing_to_explore(spark):
    frame = series(spark, {"2020-01-01": None}, "anomaly_celsius")
    assert ops.histogram(frame).isEmpty() and ops.density_curve(frame).isEmpty()


def test_exploration_tables(spark):
    values = [math.sin(i / 9) for i in range(60)]
    table = plans.build_anomaly_table(
        series(spark, run_of_days("1999-12-01", values)), climatology="month"
    )
    tables = plans.exploration_tables(table)
    assert tables["profile"].count() == 4
    assert tables["sst"].count() == tables["anomaly"].count() == 60
    assert {r.month for r in tables["monthly_means"].collect()} == {12, 1}
    assert tables["histogram"].count() == 50 and tables["density"].count() == 200
    band = sorted(tables["autocorrelation"].collect(), key=lambda r: r.lag)
    assert [r.lag for r in band] == list(range(1, 30))
    assert band[0].half_width == pytest.approx(1.959963984540054 / math.sqrt(60))


def test_a_repeated_cell_fails_on_an_incomplete_day(spark):
    """One cell three times and another once, of a grid of four cells."""
    rows = [("2000-01-01", 0, 10, 1.0)] * 3 + [("2000-01-01", 0, 11, 5.0)]
    cells = grid(spark, [("2000-01-01", a, o, None) for a in (0, 1) for o in (10, 11)])
    with pytest.raises(Exception, match="occurs twice"):
        ops.area_weighted_mean_sst(grid(spark, rows), cells=cells).collect()
    found = ops.coverage_quality(grid(spark, rows), cells=cells).collect()
    assert [(r["rows"], r["cells"]) for r in found] == [(4, 2)]
    assert found[0]["valid_fraction"] == pytest.approx(0.5, abs=1e-4)


def _two_series(spark):
    """One complete series, and one whose last part has no values."""
    days = [(k, day(f"2000-01-{d:02d}"), float(d * d % 7)) for k in ("a", "b") for d in range(1, 31)]
    rows = [(k, d, None if k == "b" and d.day > 15 else v) for k, d, v in days]
    return spark.createDataFrame(rows, "k string, date date, anomaly_celsius double")


def test_no_series_vanishes_from_the_metadata(spark):
    table = _two_series(spark)
    _, metadata = ops.evaluate_persistence(table, keys=["k"])
    assert {r["k"]: r["metrics"]["n"] for r in metadata.collect()} == {"a": 6, "b": 0}
    _, strict = ops.evaluate_persistence(table, keys=["k"], strict=True)
    with pytest.raises(Exception, match="no pair"):
        strict.collect()


def test_every_series_needs_reference_values(spark):
    table = _two_series(spark).withColumnRenamed("anomaly_celsius", "sst_celsius")
    period = {"reference_start": "2000-01-16", "reference_end": "2000-01-31", "keys": ["k"]}
    with pytest.raises(ValueError, match="reference period"):
        ops.calculate_climatology(table, strict=True, **period)
    mapped, _ = ops.calculate_climatology(table, **period)
    assert mapped.count() == 60


def test_a_region_off_the_grid_is_told(spark):
    cells = grid(spark, [("2000-01-01", a, o, 1.0) for a in (0, 1, 2) for o in (10, 11)])
    schema = "region string, lat_min double, lat_max double, lon_min double, lon_max double"
    regions = spark.createDataFrame([("on", 0.0, 1.0, 10.0, 11.0), ("off", 50.0, 60.0, 10.0, 11.0)], schema)
    counted = ops.region_cells(regions, cells)
    assert {r["region"]: r["cells"] for r in counted.collect()} == {"on": 4, "off": 0}
    assert plans.series_of_regions(cells, regions, cells=cells).count() == 1
    with pytest.raises(ValueError, match="no cell"):
        plans.series_of_regions(cells, regions, cells=cells, strict=True)


def test_regions_by_cells_and_by_rows_agree(spark):
    rows = grid(spark, [("2000-01-01", a / 2, o / 2, 1.0) for a in range(20) for o in range(20, 40)])
    schema = "region string, lat_min double, lat_max double, lon_min double, lon_max double"
    regions = spark.createDataFrame(
        [("a", 0.0, 3.0, 10.0, 14.5), ("b", 2.5, 9.0, 12.0, 13.0), ("c", 0.25, 0.3, 10.0, 19.0)], schema
    )
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    found = []
    for limit in (before, "-1"):
        spark.conf.set(threshold, limit)
        for cells in (None, rows):
            out = ops.assign_regions(rows, regions, cells=cells, nonnegative_lon=True)
            found.append(sorted(map(tuple, out.collect())))
    spark.conf.set(threshold, before)
    assert found[0] and all(f == found[0] for f in found)


def test_repeated_dates_fail_in_every_series_operator(spark):
    twice = series(spark, {"2000-01-01": 1, "2000-01-02": 2, "2000-01-03": 3})
    twice = twice.union(twice.filter("date = '2000-01-02'"))
    once = series(spark, {"2000-01-01": 1}).withColumnRenamed("sst_celsius", "other")
    for frame in (
        ops.bracket_valid(twice),
        ops.chronological_split(twice),
        ops.align_series(twice, once),
        ops.align_series(once, twice),
    ):
        with pytest.raises(Exception, match="occurs twice"):
            frame.collect()


def test_spanned_dates(spark):
    days = series(spark, {"2000-02-27": 1, "2000-03-01": 2})
    found = sorted(str(r["date"]) for r in ops.spanned_dates(days).collect())
    assert found == ["2000-02-27", "2000-02-28", "2000-02-29", "2000-03-01"]
    assert ops.spanned_dates(days.limit(0)).count() == 0
    with pytest.raises(Exception, match="record begins"):
        ops.spanned_dates(series(spark, {"1970-01-01": 1})).collect()
