"""Small builders shared by the tests."""

import datetime as dt

import pandas as pd

from gridseries import schemas


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows, value="sst_celsius"):
    """A daily series from ``{date text: value}``."""
    return spark.createDataFrame(
        [(day(d), None if v is None else float(v)) for d, v in rows.items()],
        f"date date, {value} double",
    )


def run_of_days(start, values):
    return {
        str((pd.Timestamp(start) + pd.Timedelta(days=i)).date()): v for i, v in enumerate(values)
    }


def grid(spark, rows):
    return spark.createDataFrame(
        [(day(d), float(a), float(o), None if v is None else float(v)) for d, a, o, v in rows],
        schemas.GRID,
    )


def by_day(frame, column):
    return {str(r["date"]): r[column] for r in frame.collect()}
