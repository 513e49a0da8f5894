"""Boxes across the seam, rejected regions, stored series, streams, footers, bits."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridseries import operators as ops
from gridseries import plans, schemas, sinks, sources, streaming
from gridseries.operators.region import ANTIMERIDIAN, NO_OVERLAP, OUT_OF_RANGE
from gridseries.session import discard, stored
from tests.helpers import day, grid
from tests.test_query_plans import SF_DIR, exchanges, physical
from workload import views
from workload.queries import all_queries


def fails(frame, text):
    with pytest.raises(Exception, match=text):
        frame.collect()


# --- Repeated cells by bits ------------------------------------------------------


def test_bits_count_what_sets_count(spark):
    """Irregular, missing and unknown longitudes, repeated cells, days with few cells."""
    rng = random.Random(1)
    lons = [0.0, 0.1, 0.25, 1.0, 7.5, 100.0, *[200.0 + i * 0.3 for i in range(150)], float("nan"), None]
    rows = [
        (day("2020-01-01") + dt.timedelta(days=rng.randrange(9)), rng.choice([-90.0, 10.0, 89.5]), rng.choice(lons),
         rng.choice([None, float("nan"), 1.0, 2.5, -3.0]))
        for _ in range(3000)
    ]
    frame = spark.createDataFrame(rows, schemas.GRID)
    known = spark.createDataFrame([(0.0, x) for x in lons[::2]], "lat double, lon double")

    def same(x):
        return "nan" if x is not None and x != x else x

    for cells in (frame, known):
        out = {r["date"]: r for r in ops.daily_sums(frame, cells=cells).collect()}
        for d in {r[0] for r in rows}:
            mine = [(a, same(o), None if v is None or v != v else v) for x, a, o, v in rows if x == d]
            valid = {(a, o) for a, o, v in mine if v is not None}
            assert out[d]["rows"] == len(mine)
            assert out[d]["cells"] == len({(a, o) for a, o, _ in mine})
            assert out[d]["_valid"] == len(valid)
            weight = sum(max(math.cos(math.radians(a)), 0) for a, _ in valid)
            assert abs(out[d]["valid_weight"] - weight) < 1e-9
            total = sum(max(math.cos(math.radians(a)), 0) * v for a, _, v in mine if v is not None)
            assert abs(out[d]["_total"] - total) < 1e-6


def test_a_repeated_cell_fails_however_the_rows_are_dealt(spark):
    rows = [("2020-01-01", 1, x, 1.0) for x in range(130)] + [("2020-01-02", 1, 5, 2.0)]
    frame = grid(spark, [*rows, ("2020-01-02", 1, 5, None)]).repartition(7)
    fails(ops.coverage_by_day(frame), "a cell occurs twice on a date")
    assert ops.coverage_by_day(grid(spark, rows).repartition(7)).count() == 2


def test_words_put_together_equal_words_of_all(spark):
    rows = [(f"2020-01-{1 + i % 5:02d}", i % 3, i % 70 + i // 210 * 70, float(i)) for i in range(1000)]
    frame = grid(spark, rows)
    cells = frame.select("lat", "lon").distinct()
    parts = [ops.word_sums(frame.filter(F.col("lon") % 3 == i), cells=cells) for i in range(3)]
    merged = ops.merged_words(parts[0].union(parts[1]).union(parts[2]))
    whole = ops.word_sums(frame, cells=cells)
    columns = whole.columns
    assert sorted(map(tuple, merged.select(*columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


# --- Boxes across the seam ------------------------------------------------------


def lons_of(frame):
    return sorted({r["lon"] for r in frame.collect()})


@pytest.mark.parametrize(
    "nonnegative, region, expected",
    [
        (False, ops.Region(0, 1, 170, 190), [-180.0, -170.0, 170.0]),
        (False, ops.Region(0, 1, 170, 175), [170.0]),
        (True, ops.Region(0, 1, -20, 10), [0.0, 10.0, 340.0, 350.0]),
        (True, ops.Region(0, 1, 0, 360), [x * 10.0 for x in range(36)]),
        (False, ops.Region(0, 1, -180, 180), [x * 10.0 - 180 for x in range(36)]),
    ],
)
def test_boxes_across_the_seam(spark, nonnegative, region, expected):
    lons = [x * 10.0 - (0 if nonnegative else 180) for x in range(36)]
    frame = grid(spark, [("2020-01-01", 0.5, x, 1.0) for x in lons])
    found = ops.select_region(frame, region, nonnegative_lon=nonnegative, allow_wrap=True)
    assert lons_of(found) == pytest.approx(expected)
    table = spark.createDataFrame(
        [("a", *map(float, (region.lat_min, region.lat_max, region.lon_min, region.lon_max)))], schemas.REGIONS
    )
    convention = {"nonnegative_lon": nonnegative, "allow_wrap": True}
    assert lons_of(ops.assign_regions(frame, table, **convention)) == expected
    cells = frame.select("lat", "lon")
    assert lons_of(ops.assign_regions(frame, table, cells=cells, **convention)) == expected
    assert [tuple(r) for r in ops.region_cells(table, cells, **convention).collect()] == [("a", len(expected))]
    mean = plans.series_of_regions(frame, table, cells=cells, **convention).collect()
    assert [(r["region"], r["sst_celsius"]) for r in mean] == [("a", 1.0)]


def test_a_box_across_the_seam_is_refused_by_default(spark):
    frame = grid(spark, [("2020-01-01", 0.5, 170, 1.0)])
    with pytest.raises(ValueError, match=ANTIMERIDIAN):
        ops.select_region(frame, ops.Region(0, 1, 170, 190), nonnegative_lon=False)
    table = spark.createDataFrame([("a", 0.0, 1.0, 170.0, 190.0)], schemas.REGIONS)
    fails(ops.assign_regions(frame, table, nonnegative_lon=False), ANTIMERIDIAN)


def test_both_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "grid")
    lons = [x * 10.0 - 180 for x in range(36)]
    sinks.write_grid(grid(spark, [("2020-01-01", 0.5, x, 1.0) for x in lons]), path)
    found = ops.select_region(
        sources.read_grid(spark, path), ops.Region(0, 1, 170, 190), nonnegative_lon=False, allow_wrap=True
    )
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert "Or(" in pushed
    for bound in ("lon,-180.0", "lon,-170.0", "lon,170.0", "lon,180.0", "lat,0.0", "lat,1.0"):
        assert bound in pushed


# --- Rejected regions -----------------------------------------------------------


def test_rejected_regions_have_a_reason(spark):
    nan = float("nan")
    rows = [
        ("good", 0.0, 10.0, 100.0, 110.0), ("good", 0.0, 5.0, 100.0, 110.0), ("nan", nan, 10.0, 100.0, 110.0),
        ("null", 0.0, None, 100.0, 110.0), ("order", 10.0, 0.0, 100.0, 110.0), ("range", 0.0, 91.0, 0.0, 1.0),
        ("seam", 0.0, 10.0, -10.0, 10.0), ("off", 20.0, 30.0, 100.0, 110.0), (None, 20.0, 30.0, 100.0, 110.0),
        (None, 0.0, 10.0, 100.0, 110.0),
    ]
    table = spark.createDataFrame(rows, schemas.REGIONS)
    cells = spark.createDataFrame([(5.0, 105.0), (5.0, 0.0)], "lat double, lon double")
    found = ops.quarantine_regions(table, nonnegative_lon=True).collect()
    reasons = {}
    for r in found:
        reasons.setdefault(r["region"], []).append(r["reason"])
    assert reasons["good"] == [None, None] and reasons["off"] == [None]
    assert {reasons[x][0] for x in ("nan", "null", "order", "range")} == {OUT_OF_RANGE}
    assert reasons["seam"] == [ANTIMERIDIAN]
    named = table.filter("region IS NOT NULL")
    found = ops.quarantine_regions(named, nonnegative_lon=True, cells=cells, allow_wrap=True)
    assert found.columns == [*table.columns, "reason"]
    reasons = {(r["region"], r["reason"]) for r in found.collect()}
    assert {("off", NO_OVERLAP), ("seam", None), ("good", None), ("nan", OUT_OF_RANGE)} <= reasons
    usable = found.filter("reason IS NULL AND (region <> 'good' OR lat_max = 10)").drop("reason")
    usable = stored(usable, "usable")
    frame = grid(spark, [("2020-01-01", 5, 105, 1.0), ("2020-01-01", 5, 0, 3.0)])
    series = plans.series_of_regions(frame, usable, cells=cells, nonnegative_lon=True, allow_wrap=True)
    assert {(r["region"], round(r["sst_celsius"], 9)) for r in series.collect()} == {("good", 1.0), ("seam", 3.0)}
    assert ops.quarantine_regions(table.limit(0), nonnegative_lon=True, cells=cells).count() == 0


def test_overlapping_boxes_of_one_region_fail(spark):
    table = spark.createDataFrame(
        [("a", 0.0, 10.0, 100.0, 110.0), ("a", 5.0, 15.0, 100.0, 110.0)], schemas.REGIONS
    )
    frame = grid(spark, [("2020-01-01", 5, 105, 1.0)])
    with pytest.raises(Exception, match="boxes of one region overlap"):
        plans.series_of_regions(frame, table, nonnegative_lon=True).collect()


# --- Series stored by key ---------------------------------------------------------


def test_no_exchange_between_a_stored_table_and_the_forecast(spark, tmp_path):
    table = plans.build_anomaly_table(views.nation_series(spark, SF_DIR), keys=["nation"])
    path = str(tmp_path / "series")
    sinks.write_series(table, path, keys=["nation"], buckets=4)
    read = sources.read_anomaly_table(spark, path, keys=["nation"], format="series")
    predictions, metadata = ops.evaluate_persistence(read, keys=["nation"])
    for frame in (predictions, metadata):
        assert exchanges(physical(frame)) == []
    again = plans.build_anomaly_table(sources.read_series(spark, path).select("nation", "date", "sst_celsius"), keys=["nation"])
    assert exchanges(physical(again)) == []
    expected = ops.evaluate_persistence(table, keys=["nation"])[1]
    assert sorted(map(str, metadata.collect())) == sorted(map(str, expected.collect()))
    # Another session finds the layout beside the data.
    other = spark.newSession()
    assert other.catalog.listTables() == spark.catalog.listTables()
    name = sources.buckets.table_name(path)
    spark.sql(f"DROP TABLE {name}")
    read = sources.read_anomaly_table(spark, path, keys=["nation"], format="series")
    assert exchanges(physical(ops.evaluate_persistence(read, keys=["nation"])[1])) == []
    assert read.count() == table.count()


def test_a_stored_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "series")
    for values, buckets in ((30, 3), (5, 2)):
        frame = spark.range(values).select(
            F.concat(F.lit("k"), F.col("id") % 3).alias("a key"), (F.col("id") % 2).alias("k2"),
            F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.col("id").alias("x"),
        )
        sinks.write_series(frame, path, keys=["a key", "k2"], buckets=buckets)
        assert sorted(r["x"] for r in sources.read_series(spark, path).collect()) == list(range(values))
    sinks.write_series(frame.limit(0), path, keys=["k2"], buckets=2)
    assert sources.read_series(spark, path).count() == 0
    for bad in ({"keys": []}, {"keys": ["k2"], "buckets": -1}, {"keys": ["absent"]}):
        with pytest.raises(ValueError):
            sinks.write_series(frame, path, **bad)


def test_the_forecast_job_reads_stored_series(spark, tmp_path):
    series = views.nation_series(spark, SF_DIR)
    table = plans.build_anomaly_table(series, keys=["nation"], reference_start="1995", reference_end="1999")
    path = str(tmp_path / "series")
    sinks.write_series(table, path, keys=["nation"])
    metadata = plans.persistence_job(
        spark, path, str(tmp_path / "p"), str(tmp_path / "m"), keys=["nation"], format="series", strict=False
    )
    assert metadata.count() == series.select("nation").distinct().count()


# --- Streams -----------------------------------------------------------------------


def add_files(spark, path, rows):
    grid(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_a_grid_that_grows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"2020-0{m}-{d:02d}", a, o, float(m + d + a + o)) for m in (1, 2, 3) for d in (1, 9) for a in (1, 2) for o in range(70)]
    cells = grid(spark, rows).select("lat", "lon").distinct()
    parts = [[r for i, r in enumerate(rows) if i % 3 == k] for k in range(3)]
    for k, part in enumerate(parts):
        add_files(spark, source, part)
        # What the first run has been told about cells holds.
        streaming.stream_grid(spark, source, path, cells=cells if k == 0 else cells.limit(1), late_days=40)
    streaming.stream_grid(spark, source, path, cells=cells)
    whole = {r["date"]: r for r in ops.coverage_by_day(grid(spark, rows), cells=cells).collect()}
    found = streaming.daily_of_stream(spark, path).collect()
    assert len(found) == len(whole) == 6
    for r in found:
        for c in ("mean", "valid_weight", "full_weight", "valid_fraction"):
            assert abs(r[c] - whole[r["date"]][c]) < 1e-12
    progress = sorted(map(tuple, streaming.stream_progress(spark, path).collect()))
    assert [p[1] for p in progress] == [len(p) for p in parts]
    late = [sum(r[0] < "2020-01-29" for r in p) for p in parts]
    assert [p[2] for p in progress] == [0, *late[1:]]
    # Files one by one, in a stream of its own.
    again = str(tmp_path / "again")
    streaming.stream_grid(spark, source, again, cells=cells, files_per_batch=1)
    assert streaming.stream_progress(spark, again).count() == 3
    assert streaming.daily_of_stream(spark, again).count() == 6
    # A cell that comes again, in a later run.
    add_files(spark, source, rows[:1])
    streaming.stream_grid(spark, source, path, cells=cells)
    fails(streaming.daily_of_stream(spark, path), "a cell occurs twice on a date")


def test_a_stream_of_many_grids(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    keys = [T.StructField("model", T.StringType())]
    frame = grid(spark, [("2020-01-01", 1, o, 1.0) for o in range(3)])
    both = frame.withColumn("model", F.lit("a")).union(frame.withColumn("model", F.lit("b")))
    both.write.parquet(source)
    cells = frame.select("lat", "lon")
    streaming.stream_grid(spark, source, path, cells=cells, keys=["model"], key_fields=keys)
    found = streaming.daily_of_stream(
        spark, path, keys=["model"], cells=both.select("model", "lat", "lon").distinct()
    )
    assert sorted((r["model"], r["mean"], r["valid_fraction"]) for r in found.collect()) == [("a", 1.0, 1.0), ("b", 1.0, 1.0)]
    with pytest.raises(ValueError):
        streaming.stream_grid(spark, source, path, cells=cells, late_days=-1)


# --- Footers, listings, one read ----------------------------------------------------


def test_ends_of_a_grid_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "grid")
    frame = views.nation_grid(spark, SF_DIR)
    sinks.write_grid(frame, path)
    session = sources.extent.footer_session(spark)
    plan = sources.extent.extent_of_files(session, path)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert re.search(r"PushedAggregation: \[.*MIN\(lon\)", plan)
    found = sources.grid_extent(spark, path).first()
    assert found["rows"] == frame.count()
    assert (found["lon_min"] >= 0) == ops.grid_convention(frame)
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_dates_of_files_and_of_folders(spark):
    paths = [
        "file:/a/oisst-avhrr-v02r01.20200102.nc", "/a/file=oisst-avhrr-v02r01.20200103.nc/part-0.parquet",
        "/oisst-avhrr-v02r01.20200104.nc/x/part-0.parquet", "/a/oisst-avhrr-v02r01.20201399.nc", "/a/other.20200105.nc",
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(str(r["date"]) for r in ops.dates_of_files(files).collect()) == ["2020-01-02", "2020-01-03"]


def test_exploration_reads_the_orders_once(spark):
    plan = physical(all_queries()["exploration_tables"](spark, SF_DIR))
    assert "orders.parquet" not in plan and "explored" in plan


def test_discard_removes_scratch_tables_only(spark, tmp_path):
    kept = str(tmp_path / "kept")
    spark.range(3).write.parquet(kept)
    table = stored(spark.range(5).toDF("x"), "gone")
    assert table.count() == 5
    discard(spark, table, spark.read.parquet(kept))
    assert spark.read.parquet(kept).count() == 3
    fails(table, "(?i)exist|not found|FILE_NOT")


def test_a_line_break_after_a_date_is_rejected():
    from gridseries.functions import parse_date

    with pytest.raises(ValueError):
        parse_date("2020-01-05\n")
