"""Properties of the physical plans that matter at scale."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gridseries import operators as ops
from gridseries import plans, sinks, sources
from workload import views
from workload.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (\w+)\(?([^)]*)", plan)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = physical(all_queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if "acf" not in name and name != "exploration_tables":
        assert "Python" not in plan and "Pandas" not in plan


def test_box_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "grid")
    sinks.write_grid(views.nation_grid(spark, SF_DIR), path)
    series = plans.regional_series(sources.read_grid(spark, path), ops.Region(29, 41, 114, 126))
    plan = series._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert pushed
    for filters in pushed:
        for bound in ("lat,29.0", "lat,41.0", "lon,114.0", "lon,126.0"):
            assert bound in filters
    assert "ReadSchema: struct<lat:double,lon:double>" in plan


def test_regions_table_bounds_the_scan(spark, tmp_path):
    path = str(tmp_path / "grid")
    sinks.write_grid(views.nation_grid(spark, SF_DIR), path)
    joined = ops.assign_regions(
        sources.read_grid(spark, path), views.region_table(spark, SF_DIR), nonnegative_lon=True
    )
    scan = [x for x in physical(joined).splitlines() if "FileScan" in x and "lat" in x][0]
    assert "Subquery" in scan.split("DataFilters:")[1]


def test_one_shuffle_from_series_to_forecast(spark):
    """Filling, climatology and forecast share the partitioning on the keys."""
    days = F.expr("date_add(date'1995-01-01', cast(id % 700 as int))")
    rows = spark.range(7000).select(
        F.floor(F.col("id") / 700).alias("k"), days.alias("date"), F.rand(1).alias("sst_celsius")
    )
    table = plans.build_anomaly_table(rows, keys=["k"], strict=True)
    _, metadata = ops.evaluate_persistence(table, keys=["k"])
    assert len(exchanges(physical(metadata))) == 1


def below_exchanges(plan):
    """For each exchange its keys and the operator whose rows it takes."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    out = []
    for line, following in zip(lines, lines[1:]):
        found = re.search(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning\((.*?)\), ENSURE", line)
        if found:
            out.append((re.sub(r"#\d+L?|, \d+$", "", found[1]), following))
    return out


def stored_grid(spark, tmp_path):
    path = str(tmp_path / "grid")
    sinks.write_grid(views.supplier_grid(spark, SF_DIR), path)
    return sources.read_grid(spark, path)


def coverage(grid, spark):
    return ops.coverage_quality(grid)


def one_region(grid, spark):
    return plans.regional_series(grid, ops.Region(31, 39, 115, 127), nonnegative_lon=True)


def many_regions(grid, spark):
    return plans.series_of_regions(
        grid, views.customer_regions(spark, SF_DIR), name="nation", nonnegative_lon=True
    )


@pytest.mark.parametrize("job", [coverage, one_region, many_regions])
def test_rows_of_a_stored_grid_are_not_exchanged(spark, tmp_path, job):
    """Sums and bits of cells are built below every exchange of measurements, and
    nothing is dealt out by cell; repeated cells are still found (see test_edges)."""
    plan = physical(job(stored_grid(spark, tmp_path), spark))
    found = below_exchanges(plan)
    by_word = [(keys, below) for keys, below in found if "_word" in keys]
    assert len(by_word) == 1 and "date" in by_word[0][0] and "lon" not in by_word[0][0].replace("_lon", "")
    assert "HashAggregate" in by_word[0][1] and "bit_or" in by_word[0][1] and "count" in by_word[0][1]
    for keys, below in found:
        assert "Aggregate" in below, (keys, below)
        assert "lat" not in keys or "date" not in keys or "_word" in keys, keys


def test_overlapping_regions_do_not_multiply_the_rows(spark, tmp_path):
    """200 boxes over one grid: no operator on raw rows gives out more than the grid."""
    path = str(tmp_path / "grid")
    cells = spark.range(6400).select(
        (F.floor(F.col("id") / 80) / 4).alias("lat"), (F.col("id") % 80 / 4 + 100.0).alias("lon")
    )
    days = spark.range(30).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"))
    sinks.write_grid(days.join(cells).withColumn("sst", F.col("lat") + F.dayofmonth("date")), path)
    grid = sources.read_grid(spark, path)
    boxes = spark.range(200).select(
        "id", (F.col("id") % 5 + 0.0).alias("lat_min"), (F.col("id") % 7 + 12.0).alias("lat_max"),
        (F.col("id") % 3 + 100.0).alias("lon_min"), (F.col("id") % 4 + 112.0).alias("lon_max"),
    )
    series = plans.series_of_regions(grid, boxes, name="id", cells=cells, nonnegative_lon=True)
    rows = series.collect()
    assert len(rows) == 200 * 30
    counted = executed_rows(series)
    assert max(n for _, n in counted) == max(n for node, n in counted if "Scan" in node) == 30 * 6400
    for r in rows[::997]:
        i = r["id"]
        lats = [x / 4 for x in range(80) if i % 5 <= x / 4 <= i % 7 + 12]
        weight = [math.cos(math.radians(x)) for x in lats]
        mean = sum(w * x for w, x in zip(weight, lats)) / sum(weight) + r["date"].day
        assert abs(r["sst_celsius"] - mean) < 1e-9


def executed_rows(frame):
    """Name and number of output rows of every operator that ran."""
    out, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in name:
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            out.append((name, rows.get().value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_planning_a_dry_run_reads_nothing(spark):
    existing = views.orders_by_day(spark, SF_DIR).select("date")
    plan = ops.plan_downloads(
        spark, "2000-01-01", "2000-02-01", existing, output_dir="raw", dry_run=True
    )
    assert "FileScan" not in physical(plan)


@pytest.mark.parametrize("name", ["histogram_orders", "kde_orders"])
def test_raw_rows_stay_where_they_are(spark, name):
    """Keys are few, so rows must not be dealt out by them: the table of keys is
    small enough to go to the rows, and only sums are exchanged. The limit lies
    far below what the orders take, as it does at scale."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "8k")
    try:
        frame = all_queries()[name](spark, SF_DIR)
        frame.collect()
        plan = physical(frame).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "BuildRight" in plan
    below = [plan[m.end() :].split("\n", 2)[1] for m in re.finditer(r" Exchange hash.*", plan)]
    assert below and all("Aggregate" in x or "WholeStage" in x for x in below), below


def test_calendars_come_from_a_scan(spark):
    for name in ("gen_calendar", "ingest_plan", "ingest_counts_overwrite", "ingest_counts_dry_run"):
        assert "FileScan" in physical(all_queries()[name](spark, SF_DIR)), name
