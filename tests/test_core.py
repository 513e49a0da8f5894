"""The fixtures of FIXTURES.md."""

import math

import pytest

from gridseries import operators as ops
from gridseries.plans import build_anomaly_table
from gridseries.operators.calendar import check_date_range
from tests.helpers import by_day, day, grid, run_of_days, series


def test_box_keeps_cells_inside_for_descending_latitude(spark):
    cells = [(a, o) for a in (40, 35, 30) for o in (115, 120, 125, 130)]
    frame = spark.createDataFrame(
        [(float(a), float(o), float(i)) for i, (a, o) in enumerate(cells)],
        "lat double, lon double, value double",
    )
    kept = ops.select_region(frame, ops.Region(31, 39, 117, 127)).collect()
    assert {(r.lat, r.lon) for r in kept} == {(35.0, 120.0), (35.0, 125.0)}


def test_weighted_mean_and_coverage(spark):
    frame = grid(
        spark,
        [
            ("2000-01-01", 0, 120, 10), ("2000-01-01", 0, 121, 10),
            ("2000-01-01", 60, 120, 20), ("2000-01-01", 60, 121, 20),
            ("2000-01-02", 0, 120, None), ("2000-01-02", 0, 121, None),
            ("2000-01-02", 60, 120, 20), ("2000-01-02", 60, 121, None),
        ],
    )
    means = by_day(ops.area_weighted_mean_sst(frame, min_valid_fraction=0.5), "sst")
    assert means["2000-01-01"] == pytest.approx(40 / 3)
    assert means["2000-01-02"] is None
    shares = by_day(ops.coverage_by_day(frame), "valid_fraction")
    assert shares["2000-01-02"] == pytest.approx(1 / 6)
    everything = ops.area_weighted_mean_sst(frame, min_valid_fraction=0.1)
    assert by_day(everything, "sst")["2000-01-02"] == pytest.approx(20)


def test_short_gap_is_filled_and_long_gap_only_at_its_start(spark):
    frame = series(spark, {"2000-01-01": 10, "2000-01-03": 12, "2000-01-07": 20})
    filled = ops.regularize_and_fill(frame, max_gap_days=1)
    values, flags = by_day(filled, "sst_celsius"), by_day(filled, "is_interpolated")
    assert values["2000-01-02"] == pytest.approx(11) and flags["2000-01-02"] is True
    assert values["2000-01-04"] == pytest.approx(14) and flags["2000-01-04"] is True
    assert values["2000-01-05"] is None and flags["2000-01-05"] is False
    assert len(values) == 7
    whole = by_day(ops.regularize_and_fill(frame, max_gap_days=3), "sst_celsius")
    assert None not in whole.values()


def test_monthly_cycle_uses_the_reference_period_only(spark):
    frame = series(
        spark, {"1991-01-01": 10, "1991-01-02": 12, "1991-02-01": 20, "2021-01-01": 100}
    )
    mapped, cycle = ops.calculate_climatology(frame, frequency="month")
    assert {r.season: r.sst_celsius for r in cycle.collect()} == {1: 11.0, 2: 20.0}
    assert by_day(mapped, "climatology_celsius")["2021-01-01"] == pytest.approx(11)


def test_anomaly_is_the_difference_to_the_calendar_day_mean(spark):
    frame = series(
        spark, {"1991-01-01": 10, "1991-01-02": 20, "1992-01-01": 12, "1992-01-02": 18}
    )
    table = build_anomaly_table(
        frame, max_gap_days=0, reference_start="1991-01-01", reference_end="1992-12-31"
    )
    assert table.columns == [
        "date", "sst_celsius", "is_interpolated", "climatology_celsius", "anomaly_celsius",
    ]
    rows = {str(r.date): r for r in table.collect()}
    assert len(rows) == 367  # 365 days of 1991 and two of 1992
    assert rows["1991-01-01"].climatology_celsius == pytest.approx(11)
    assert rows["1991-01-01"].anomaly_celsius == pytest.approx(-1)


def test_persistence_is_the_day_before(spark):
    frame = series(spark, run_of_days("2020-01-01", [0.5, 1.0, -0.5]), "anomaly_celsius")
    got = by_day(ops.persistence_predictions(frame), "predicted_anomaly_celsius")
    assert got == {"2020-01-01": None, "2020-01-02": 0.5, "2020-01-03": 1.0}


def test_metrics_skip_pairs_that_are_not_finite(spark):
    frame = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 2.0), (float("nan"), 9.0), (None, 1.0), (1.0, math.inf)],
        "observed double, predicted double",
    )
    row = ops.regression_metrics(frame).first()
    assert (row.n, row.mae) == (2, 0.5)
    assert row.rmse == pytest.approx(2**-0.5)
    assert ops.finite_pairs(frame).count() == 2


def test_evaluation_takes_the_last_part_of_the_record(spark):
    frame = series(spark, run_of_days("2020-01-01", [0, 1, 2, 4, 7]), "anomaly_celsius")
    test, metadata = ops.evaluate_persistence(frame, test_fraction=0.4)
    assert by_day(test, "predicted_anomaly_celsius") == {"2020-01-04": 2.0, "2020-01-05": 4.0}
    assert by_day(test, "error_celsius") == {"2020-01-04": -2.0, "2020-01-05": -3.0}
    row = metadata.first()
    assert row.split_method == "final chronological fraction"
    assert row.baseline == "one-day persistence"
    assert row.target == "sst anomaly (degrees Celsius)"
    assert (row.random_seed, row.test_fraction) == (42, 0.4)
    assert (row.test_start, row.test_end) == ("2020-01-04", "2020-01-05")
    assert row.metrics.n == 2 and row.metrics.mae == pytest.approx(2.5)


def test_file_keys(spark):
    days = spark.createDataFrame([(day("2020-02-29"),)], "date date")
    row = ops.with_file_keys(days, output_dir="raw").first()
    assert row.url.endswith("/202002/oisst-avhrr-v02r01.20200229.nc")
    assert "preliminary" not in row.url
    assert row.destination == "raw/202002/oisst-avhrr-v02r01.20200229.nc"


def test_date_range_is_inclusive_and_bounded_below(spark):
    days = [str(r.date) for r in ops.date_range(spark, "1981-09-01", "1981-09-03").collect()]
    assert sorted(days) == ["1981-09-01", "1981-09-02", "1981-09-03"]
    with pytest.raises(ValueError, match="begins"):
        ops.date_range(spark, "1981-08-31", "1981-09-01")
    with pytest.raises(ValueError):
        check_date_range("2000-01-02", "2000-01-01")
