"""Spark session settings for local runs, and the shared scratch folder."""

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", *, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridseries")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table.

    It lies in the shared folder that ``spark.checkpoint.dir`` names or that
    ``SparkContext.setCheckpointDir`` was given, so the table outlives the
    executors that wrote it. Where neither is set, a session on this machine
    alone, as in tests, takes a temporary folder; a cluster is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the scratch folder and read back.

    What the plan computes is computed once, its checks have fired, and Spark
    knows the table's true size.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of scratch tables that nothing will read any more.

    Only files that were written by :func:`scratch_path` names, thus with a unique
    suffix, are touched; other tables are left alone. Spark drops the shuffle files
    of plans that have run when the driver collects its garbage, which a driver
    that waits for long jobs seldom does by itself.
    """
    jvm = spark._jvm
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if re.fullmatch(r".*-[0-9a-f]{32}", folder):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
