"""Date keys, strict date parsing and per-day file names."""

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridseries import constants as C

# Fixed value: year-month-day with a four-digit year, leading zeros optional.
ISO_DATE_PATTERN = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_date(value: str | dt.date) -> dt.date:
    """One calendar date from text; the error names the offending value."""
    if isinstance(value, dt.date):
        return value
    try:
        if not re.fullmatch(ISO_DATE_PATTERN, value):
            raise ValueError(value)
        return dt.date(*map(int, value.split("-")))
    except ValueError:
        raise ValueError(f"{value!r} is not a date of the form YYYY-MM-DD") from None


def iso_date(value: Column | str, *, on_error: str = "raise") -> Column:
    """Strict date parse of a text column.

    ``on_error="null"`` gives NULL for text that is no date, ``"raise"`` fails
    the query and names the text. NULL input stays NULL.
    """
    value = _column(value)
    parsed = F.when(value.rlike(ISO_DATE_PATTERN), F.try_to_date(value, "yyyy-M-d"))
    if on_error == "null":
        return parsed
    message = F.format_string("'%s' is not a date of the form YYYY-MM-DD", value)
    return F.when(value.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def day_stamp(day: Column | str) -> Column:
    return F.date_format(_column(day), "yyyyMMdd")


def month_stamp(day: Column | str) -> Column:
    return F.date_format(_column(day), "yyyyMM")


def day_key(day: Column | str) -> Column:
    """Calendar-day key ``MM-DD``; the same in leap and common years."""
    return F.date_format(_column(day), "MM-dd")


def file_name(day: Column | str) -> Column:
    return F.concat(F.lit(C.FILE_PREFIX), day_stamp(day), F.lit(C.FILE_SUFFIX))


def file_path(day: Column | str, root: str) -> Column:
    """``root/YYYYMM/name``, the layout of the daily files."""
    return F.concat_ws("/", F.lit(root), month_stamp(day), file_name(day))


def file_url(day: Column | str, base_url: str = C.BASE_URL) -> Column:
    return file_path(day, base_url)
