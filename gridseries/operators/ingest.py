"""Which daily files to fetch: keys, plan and counts. Nothing is fetched here."""

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries import constants as C
from gridseries.checks import require_columns
from gridseries.functions import file_path, file_url
from gridseries.operators.calendar import date_range


def with_file_keys(
    days: DataFrame, *, output_dir: str, base_url: str = C.BASE_URL
) -> DataFrame:
    """Add the source URL and the destination path of each day's file."""
    require_columns(days, [C.DATE], "days")
    return days.withColumns(
        {"url": file_url(C.DATE, base_url), "destination": file_path(C.DATE, output_dir)}
    )


def dates_of_files(files: DataFrame) -> DataFrame:
    """Dates carried by the names of listed files (see ``sources.list_files``), or
    by those of folders that hold one file in parts."""
    require_columns(files, ["path"], "files")
    stamp = F.regexp_extract("path", re.escape(C.FILE_PREFIX) + r"([0-9]{8})\.[^/]*(/[^/]*)?$", 1)
    return (
        files.select(F.try_to_date(F.nullif(stamp, F.lit("")), "yyyyMMdd").alias(C.DATE))
        .filter(F.col(C.DATE).isNotNull())
        .distinct()
    )


def missing_dates(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted dates that are not stored yet."""
    for frame in (wanted, existing):
        require_columns(frame, [C.DATE], "dates")
    return wanted.join(existing, C.DATE, "left_anti")


def plan_downloads(
    spark: SparkSession,
    start: str | dt.date,
    end: str | dt.date,
    existing: DataFrame | None = None,
    *,
    output_dir: str,
    overwrite: bool = False,
    dry_run: bool = False,
    base_url: str = C.BASE_URL,
    first_available: dt.date | None = C.FIRST_AVAILABLE_DATE,
) -> DataFrame:
    """Date, URL, destination and action for every day of a range.

    ``existing`` holds the dates already stored. Its days are ``skipped`` and
    the others ``downloaded`` (that is: to be fetched), unless ``overwrite``
    fetches all or ``dry_run`` marks all as ``planned`` without a look at
    ``existing``.
    """
    wanted = date_range(spark, start, end, first_available=first_available)
    return plan_days(
        wanted, existing,
        output_dir=output_dir, overwrite=overwrite, dry_run=dry_run, base_url=base_url,
    )


def plan_days(
    wanted: DataFrame,
    existing: DataFrame | None = None,
    *,
    output_dir: str,
    overwrite: bool = False,
    dry_run: bool = False,
    base_url: str = C.BASE_URL,
) -> DataFrame:
    """As :func:`plan_downloads`, for days that a table lists."""
    require_columns(wanted, [C.DATE], "days")
    if dry_run or overwrite or existing is None:
        action = F.lit("planned" if dry_run else "downloaded")
        plan = wanted.withColumn("action", action)
    else:
        stored = existing.select(C.DATE).distinct().withColumn("_stored", F.lit(True))
        plan = wanted.join(stored, C.DATE, "left").select(
            C.DATE,
            F.when(F.col("_stored"), "skipped").otherwise("downloaded").alias("action"),
        )
    keyed = with_file_keys(plan, output_dir=output_dir, base_url=base_url)
    return keyed.select(C.DATE, "url", "destination", "action")


def count_actions(plan: DataFrame) -> DataFrame:
    """Number of days per action; an action without days counts zero."""
    counted = plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in C.ACTIONS])
    return counted.unpivot([], list(C.ACTIONS), "action", "n")
