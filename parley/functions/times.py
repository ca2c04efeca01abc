"""Clock and calendar parsing as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

# Accepted day and time layouts, tried in this order.
DATETIME_FORMATS = [
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy",
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
    "H:m:s d/M/yyyy", "H:m d/M/yyyy",
]


def _shape(layout: str) -> str:
    return "^" + re.sub(r"[dMHms]", r"\\d{1,2}", layout.replace("yyyy", "####")).replace("####", r"\d{4}") + "$"


def parse_seconds(c: str | Column) -> Column:
    """Seconds from a number, M:SS or H:M:SS; 0 for anything else."""
    t = strip(col(c).cast("string"))
    p = F.split(t, ":")
    n = [F.get(p, F.lit(i)).try_cast("double") for i in range(3)]
    clock = F.when(F.size(p) == 2, n[0] * 60 + n[1]).when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2])
    # A failed cast costs an exception, so clock texts do not try it.
    number = F.when(~F.contains(t, F.lit(":")), t.try_cast("double"))
    return F.coalesce(number, clock, F.lit(0.0))


def parse_user_datetime(c: str | Column) -> Column:
    """Local wall-clock time from ISO text (zoned text moves to the session zone) or a day/month layout."""
    t = strip(col(c).cast("string"))
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$"),
                   t.try_cast("timestamp").cast("timestamp_ntz"))
    plain = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), t.try_cast("timestamp_ntz"))
    # A failed parse costs an exception, so each layout first looks at the shape of the text.
    rest = [F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))).cast("timestamp_ntz") for f in DATETIME_FORMATS]
    return F.coalesce(zoned, plain, *rest)


def parse_date(c: str | Column) -> Column:
    """ISO day text from ISO or day/month/year text."""
    t = col(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(
        F.date_format(F.try_to_timestamp(t, F.lit("d/M/yyyy")), "yyyy-MM-dd"))


def format_datetime(c: str | Column) -> Column:
    return F.coalesce(F.date_format(col(c), "dd/MM/yyyy HH:mm"), F.lit(""))


def format_day(c: str | Column) -> Column:
    return F.coalesce(F.date_format(col(c), "dd/MM/yyyy"), F.lit(""))


def format_clock(c: str | Column) -> Column:
    return F.coalesce(F.concat(F.date_format(col(c), "HH"), F.lit(" giờ "), F.date_format(col(c), "mm")), F.lit(""))


def segment_duration(start: str | Column, end: str | Column) -> Column:
    """Length of a turn, never negative; a missing or zero end means no length."""
    s = F.coalesce(col(start), F.lit(0.0))
    e = F.coalesce(F.nullif(col(end), F.lit(0.0)), s)
    return F.greatest(F.lit(0.0), e - s)


def exact_round(c: str | Column, places: int = 2) -> Column:
    """Round half to even on the exact binary value, as C and Python do.

    The float part and the rest of ``x`` are scaled separately, both without
    error, so the sign of ``side`` tells exactly on which side of the half it is.
    """
    x, scale = col(c).cast("double"), 10.0 ** places
    near = x.cast("float").cast("double")
    low = F.floor(x * scale)
    side = (near * scale - (low + 0.5)) + (x - near) * scale
    up = F.when(side > 0, 1).when(side < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    return (low + up) / F.lit(scale)
