"""Series tables stored by key, so that jobs on them need no exchange."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import require_columns
from gridseries.sources.buckets import data_path, layout_path, table_name


def write_series(
    table: DataFrame, path: str, *, keys: Sequence[str], buckets: int | None = None
) -> None:
    """Write a table of many series as Parquet in ``buckets`` by its keys, each
    bucket in order of keys and date; an earlier table at ``path`` is replaced.

    ``sources.read_series`` reads it so that Spark knows where each series lies:
    filling, climatology and forecast then work without an exchange. A table that
    is dealt out by its keys already, as an anomaly table is, goes to its buckets
    as it is. ``buckets`` is ``spark.sql.shuffle.partitions`` by default; a bucket
    should fit a task, and a series of one key lies in one bucket.
    """
    require_columns(table, [*keys, C.DATE], "table")
    if not keys:
        raise ValueError("a table of one series has no keys to be stored by")
    spark = table.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if count < 1:
        raise ValueError(f"buckets must be positive, got {count!r}")
    name = table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # By number as the buckets are, so that each bucket is one file.
    dealt = table.repartition(count, *[F.col(f"`{k}`") for k in keys])
    (
        dealt.write.bucketBy(count, *keys)
        .sortBy(*keys, C.DATE)
        .option("path", data_path(path))
        .mode("overwrite")
        .format("parquet")
        .saveAsTable(name)
    )
    layout = spark.range(1).select(
        F.lit(count).alias("buckets"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(table.schema.json()).alias("schema")
    )
    layout.coalesce(1).write.mode("overwrite").json(layout_path(path))
