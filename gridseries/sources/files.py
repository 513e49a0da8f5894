"""File listings as data."""

from pyspark.sql import DataFrame, SparkSession

from gridseries import constants as C


def list_files(
    spark: SparkSession, root: str, pattern: str = C.FILE_PATTERN, *, strict: bool = True
) -> DataFrame:
    """Path and size of every file below ``root`` whose name fits ``pattern``,
    in path order.

    Only the listing is read, never the content. ``strict`` runs one small job
    and fails when nothing is found.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )
    if strict and files.isEmpty():
        raise FileNotFoundError(f"no files named {pattern} below {root}")
    return files.orderBy("path")
