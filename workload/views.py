"""Grids and series derived from the given tables.

The measured quantity is the logarithm of a price. Orders count as measured only
when they are finished (``o_orderstatus = 'F'``); a day or cell that has orders
but no finished one is present with a missing value, and a day without orders is
absent, so both kinds of gap occur. All views read whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows as measurements: ``date``, ``sst_celsius`` and their keys."""
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.ln("o_totalprice")).alias("sst_celsius"),
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_custkey").alias("custkey"),
        "o_orderstatus",
        "o_totalprice",
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: daily mean over all orders."""
    return orders_by_day(spark, sf_dir).groupBy("date").agg(
        F.avg("sst_celsius").alias("sst_celsius")
    )


def priority_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority."""
    return orders_by_day(spark, sf_dir).groupBy("series_id", "date").agg(
        F.avg("sst_celsius").alias("sst_celsius")
    )


def _orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count of values per nation and day.

    Orders are reduced to one row per customer and day before they meet the
    customers, so a customer with a large share of all orders is no hot key in
    the join.
    """
    per_customer = orders_by_day(spark, sf_dir).groupBy("custkey", "date").agg(
        F.sum("sst_celsius").alias("total"), F.count("sst_celsius").alias("n")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation")
    )
    return (
        per_customer.join(customers, "custkey")
        .groupBy("nation", "date")
        .agg(F.try_divide(F.sum("total"), F.sum("n")).alias("value"))
    )


def nation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per customer nation."""
    return _orders_by_nation(spark, sf_dir).select(
        F.col("nation").cast("bigint").alias("nation"),
        "date",
        F.col("value").alias("sst_celsius"),
    )


def _nation_cell() -> list:
    return [
        (25 + 5 * F.floor(F.col("nation") / 5)).cast("double").alias("lat"),
        (110 + 5 * (F.col("nation") % 5)).cast("double").alias("lon"),
    ]


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 grid with one cell per customer nation."""
    return _orders_by_nation(spark, sf_dir).select(
        "date", *_nation_cell(), F.col("value").alias("sst")
    )


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of :func:`nation_grid`, from the customers alone."""
    nations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return nations.distinct().select(*_nation_cell())


def _supplier_cell() -> list:
    return [
        (F.col("l_suppkey") % 25 * 0.5 + 30).alias("lat"),
        (F.floor(F.col("l_suppkey") / 25) % 40 * 0.5 + 115).alias("lon"),
    ]


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measurements of supplier cells, of which many repeat; those
    of more than 40 pieces have no value."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        *_supplier_cell(),
        F.when(F.col("l_quantity") <= 40, F.ln("l_extendedprice")).alias("sst"),
    )


def supplier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with 25 latitudes and up to 40 longitudes, one row per cell and
    ship date; a cell whose line items all exceed 40 pieces has no value."""
    rows = supplier_rows(spark, sf_dir)
    return rows.groupBy("date", "lat", "lon").agg(F.avg("sst").alias("sst"))


def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of :func:`supplier_grid`."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(
        *_supplier_cell()
    )


def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five overlapping boxes, one per row of the region table."""
    key = F.col("r_regionkey").cast("double")
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("region"),
        (key * 3 + 24).alias("lat_min"),
        (key * 3 + 36).alias("lat_max"),
        (key * 2 + 109).alias("lon_min"),
        (key * 2 + 120).alias("lon_max"),
    )


def regions_and_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of :func:`region_table`, and each again far off the grid."""
    boxes = region_table(spark, sf_dir)
    south = boxes.withColumns(
        {
            "region": F.concat("region", F.lit(" SOUTH")),
            "lat_min": F.col("lat_min") - 100,
            "lat_max": F.col("lat_max") - 100,
        }
    )
    return boxes.union(south)


def customer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each nation that customers live in."""
    nation = F.col("c_nationkey").cast("double")
    boxes = table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    return boxes.select(
        F.col("c_nationkey").cast("bigint").alias("nation"),
        (30 + nation % 7).alias("lat_min"),
        (33 + nation % 7).alias("lat_max"),
        (115 + nation % 12).alias("lon_min"),
        (119 + nation % 12).alias("lon_max"),
    )


def customer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short series per customer; many have no two days in a row."""
    return orders_by_day(spark, sf_dir).groupBy("custkey", "date").agg(
        F.avg("sst_celsius").alias("sst_celsius")
    )


def forecast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from the events, with missing and infinite values among them."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_type",
        F.when(F.hour("ts") == 1, F.lit(None))
        .when(F.hour("ts") == 2, F.lit(float("inf")))
        .otherwise(F.ln(value + 1))
        .cast("double")
        .alias("observed"),
        F.when(F.hour("ts") == 3, F.lit(float("nan")))
        .when(F.hour("ts") == 4, F.lit(float("-inf")))
        .otherwise(F.ln(value * 2 + 3))
        .alias("predicted"),
    )


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text in several spellings, some of them no ISO date."""
    day = F.to_date("o_orderdate")
    spellings = ["yyyy-MM-dd", "yyyy-M-d", "yyyyMMdd", "dd/MM/yyyy", "yyyy-MM", "yyyy-MM-'31'"]
    texts = F.array(*[F.date_format(day, s) for s in spellings])
    return table(spark, sf_dir, "orders").select(F.explode(texts).alias("text")).distinct()
