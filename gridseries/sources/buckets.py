"""Reader of series tables that are stored by key."""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridseries import constants as C


def data_path(path: str) -> str:
    return f"{path.rstrip('/')}/series"


def layout_path(path: str) -> str:
    """Where the number of buckets and the keys of a stored table are noted."""
    return f"{path.rstrip('/')}/layout"


def table_name(path: str) -> str:
    """Name under which the session knows the table stored at ``path``."""
    return "series_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``sinks.write_series``, with its buckets.

    The session's catalog takes note of the table, which stays where it is; a
    session that has not seen it before finds the layout beside the data.
    """
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.json(layout_path(path)).first()
        schema = T.StructType.fromJson(json.loads(layout["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(f"`{k}`" for k in layout["keys"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) "
            f"SORTED BY ({keys}, `{C.DATE}`) INTO {layout['buckets']} BUCKETS "
            f"LOCATION '{data_path(path)}'"
        )
    return spark.table(name)
