"""Sources, sinks, jobs and ingestion planning."""

import glob
import json
import math
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries import operators as ops
from gridseries import plans, sinks, sources
from gridseries.operators.ingest import missing_dates
from gridseries.session import scratch_path
from tests.helpers import by_day, day, grid, run_of_days, series


@pytest.fixture
def small_grid(spark):
    rows = []
    for i in range(70):
        d = str(day("1999-12-01") + (day("1999-12-02") - day("1999-12-01")) * i)
        for a in (30, 35, 38):
            for o in (118, 122):
                rows.append((d, a, o, None if (i + a + o) % 17 == 0 else 10 + math.sin(i) + a / 10))
    return grid(spark, rows)


def test_grid_round_trip_and_partition_pruning(spark, small_grid, tmp_path):
    path = str(tmp_path / "grid")
    sinks.write_grid(small_grid, path)
    assert len(glob.glob(f"{path}/ym=*")) == 3
    back = sources.read_grid(spark, path)
    assert back.columns == ["date", "lat", "lon", "sst"]
    assert back.exceptAll(small_grid).isEmpty() and back.count() == 70 * 6
    part = sources.read_grid(spark, path, start="1999-12-31", end="2000-01-31")
    assert part.select("date").distinct().count() == 32
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "ym" in plan.split("PartitionFilters:")[1].split("]")[0]
    files = sources.list_files(spark, path, "*.parquet")
    assert files.filter(F.col("path").contains("ym=200001")).count() >= 1
    with pytest.raises(FileNotFoundError):
        sources.list_files(spark, path, "*.nc")


def test_prepare_grid(spark, tmp_path):
    raw = spark.sql(
        """SELECT timestamp_ntz'2000-01-01 12:00:00' AS time, 0f AS zlev, 31.5f AS lat,
                  120f AS lon, float('NaN') AS sst, 1 AS ice"""
    )
    got = sources.prepare_grid(raw, strict=True)
    assert [f.dataType.simpleString() for f in got.schema] == ["date", "double", "double", "double"]
    assert tuple(got.first()) == (day("2000-01-01"), 31.5, 120.0, None)
    deep = raw.union(raw.withColumn("zlev", F.lit(10.0)))
    with pytest.raises(ValueError, match="depth"):
        sources.prepare_grid(deep, strict=True)
    with pytest.raises(ValueError, match="sst"):
        sources.prepare_grid(raw.drop("sst"))


def test_csv_grid(spark, small_grid, tmp_path):
    path = str(tmp_path / "csv")
    small_grid.write.option("header", True).csv(path)
    back = sources.read_grid(spark, path, format="csv")
    assert back.exceptAll(small_grid).isEmpty() and back.count() == small_grid.count()


def test_files_in_plain_folders(spark, small_grid, tmp_path):
    for month in ("199912", "200001"):
        part = small_grid.filter(F.date_format("date", "yyyyMM") == month)
        part.coalesce(1).write.parquet(str(tmp_path / "raw" / month))
    back = sources.read_grid(spark, str(tmp_path / "raw"), pattern="*.parquet", recursive=True)
    assert back.count() == 62 * 6
    with pytest.raises(FileNotFoundError):
        sources.read_grid(spark, [])


def test_jobs_end_to_end(spark, small_grid, tmp_path):
    grid_path, table_path = str(tmp_path / "grid"), str(tmp_path / "deep" / "table")
    sinks.write_grid(small_grid, grid_path)
    options = {"climatology": "month", "climatology_start": "1999", "climatology_end": "2000"}
    rows = plans.preprocess_job(spark, grid_path, table_path, min_valid_fraction=0.5, **options)
    assert rows == 70
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{table_path}/*.csv")))
    assert text.startswith("date,sst_celsius,is_interpolated,climatology_celsius,anomaly_celsius\n")
    days = [x[:10] for x in text.splitlines() if x[:4] in ("1999", "2000")]
    assert days == sorted(days) and len(days) == 70 and ",False," in text
    table = sources.read_exploration_table(spark, table_path)
    direct = plans.build_anomaly_table(
        plans.regional_series(small_grid, ops.Region(), min_valid_fraction=0.5),
        climatology="month", reference_start="1999", reference_end="2000",
    )
    a, b = by_day(table, "anomaly_celsius"), by_day(direct, "anomaly_celsius")
    assert a.keys() == b.keys()
    assert all(a[d] == pytest.approx(b[d], abs=1e-9) for d in a if b[d] is not None)

    predictions_path, metrics_path = str(tmp_path / "predictions"), str(tmp_path / "metrics")
    metadata = plans.persistence_job(spark, table_path, predictions_path, metrics_path).first()
    written = json.loads("".join(open(f).read() for f in glob.glob(f"{metrics_path}/part-*")))
    assert list(written) == [
        "baseline", "target", "split_method", "test_fraction", "test_start", "test_end",
        "random_seed", "metrics",
    ]
    assert written["metrics"] == metadata.metrics.asDict()
    assert written["random_seed"] == 42 and written["metrics"]["n"] > 0
    # A second run replaces the results of the first.
    plans.persistence_job(spark, table_path, predictions_path, metrics_path)


def test_anomaly_csv_is_read_by_column_name(spark, tmp_path):
    path = tmp_path / "table.csv"
    path.write_text(
        "anomaly_celsius,date,is_interpolated\n1.5,2000-01-01,True\n,2000-01-02,False\nNaN,2000-01-03,False\n"
    )
    table = sources.read_anomaly_table(spark, str(path))
    assert by_day(table, "anomaly_celsius") == {"2000-01-01": 1.5, "2000-01-02": None, "2000-01-03": None}
    assert by_day(table, "is_interpolated")["2000-01-01"] is True
    with pytest.raises(ValueError, match=r"\['climatology_celsius', 'sst_celsius'\]"):
        sources.read_exploration_table(spark, str(path))


def test_write_csv_replaces_and_counts(spark, tmp_path):
    frame = series(spark, run_of_days("2000-01-01", range(5)))
    path = str(tmp_path / "out")
    assert sinks.write_csv(frame, path) == 5
    assert sinks.write_csv(frame.filter("sst_celsius > 2"), path) == 2
    assert spark.read.option("header", True).csv(path).count() == 2


def test_cells_table(spark, small_grid, tmp_path):
    path = str(tmp_path / "cells")
    sinks.write_cells(small_grid, path)
    cells = spark.read.parquet(path)
    assert cells.count() == 6
    region = ops.Region()
    with_cells = plans.regional_series(small_grid, region, cells=cells, min_valid_fraction=0.5)
    without = plans.regional_series(small_grid, region, min_valid_fraction=0.5)
    assert by_day(with_cells, "sst_celsius") == pytest.approx(by_day(without, "sst_celsius"))


def test_download_plan(spark):
    existing = spark.createDataFrame([(day("2000-01-02"),), (day("1999-01-01"),)], "date date")

    def plan(**options):
        return ops.plan_downloads(
            spark, "2000-01-01", "2000-01-03", existing, output_dir="raw", **options
        )

    def counts(frame):
        return {r.action: r.n for r in ops.count_actions(frame).collect()}

    rows = {str(r.date): r for r in plan().collect()}
    assert {d: r.action for d, r in rows.items()} == {
        "2000-01-01": "downloaded", "2000-01-02": "skipped", "2000-01-03": "downloaded",
    }
    assert rows["2000-01-01"].destination == "raw/200001/oisst-avhrr-v02r01.20000101.nc"
    assert counts(plan()) == {"downloaded": 2, "skipped": 1, "planned": 0}
    assert counts(plan(overwrite=True)) == {"downloaded": 3, "skipped": 0, "planned": 0}
    assert counts(plan(dry_run=True)) == {"downloaded": 0, "skipped": 0, "planned": 3}
    assert counts(plan(dry_run=True, overwrite=True))["planned"] == 3
    wanted = ops.date_range(spark, "2000-01-01", "2000-01-03")
    assert missing_dates(wanted, existing).count() == 2


def test_scratch_folder_follows_the_session(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")

    def session(master, set_in_conf=None, set_in_context=None):
        conf = types.SimpleNamespace(get=lambda key, default: set_in_conf)
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: set_in_context)
        return types.SimpleNamespace(conf=conf, sparkContext=context)

    assert scratch_path(session("yarn", "/shared/"), "x").startswith("/shared/x-")
    assert scratch_path(session("yarn", None, "/other"), "x").startswith("/other/x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_path(session(master), "x")


def test_a_rejected_run_keeps_earlier_tables(spark, small_grid, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("anomaly", "predictions", "metrics", "grid", "table")}
    rows = run_of_days("2000-01-01", [1.0, 2.0, 4.0, 3.0, 5.0, 6.0, 2.0, 1.0, 4.0, 3.0])
    good = plans.build_anomaly_table(
        series(spark, rows), reference_start="2000-01-01", reference_end="2000-01-31"
    )
    sinks.write_csv(good, paths["anomaly"])
    plans.persistence_job(spark, paths["anomaly"], paths["predictions"], paths["metrics"])
    before = sorted(spark.read.text(paths["predictions"]).collect())
    assert len(before) >= 2
    late = F.col("date") < "2000-01-08"
    sinks.write_csv(
        good.withColumn("anomaly_celsius", F.when(late, F.col("anomaly_celsius"))), paths["anomaly"]
    )
    with pytest.raises(Exception, match="no pair"):
        plans.persistence_job(spark, paths["anomaly"], paths["predictions"], paths["metrics"])
    assert sorted(spark.read.text(paths["predictions"]).collect()) == before
    # The other job: a repeated cell is found before the output is touched.
    sinks.write_csv(good, paths["table"])
    kept = sorted(spark.read.text(paths["table"]).collect())
    sinks.write_grid(small_grid.union(small_grid), paths["grid"])
    with pytest.raises(Exception, match="occurs twice"):
        plans.preprocess_job(
            spark, paths["grid"], paths["table"],
            climatology_start="1981-01-01", climatology_end="2030-12-31",
        )
    assert sorted(spark.read.text(paths["table"]).collect()) == kept
