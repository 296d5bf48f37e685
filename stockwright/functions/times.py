"""Time keys and time text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Weekday labels, Monday first; the grains a time field may be grouped by.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
GRAINS = ["day", "week", "month", "quarter", "year", "weekday"]

# The time layouts a retail file may use, in the order tried, as Java patterns, and the
# two day-first layouts that inference also tries so that a day-first file is flagged, not misread.
DATE_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "M/d/yyyy H:m",
    "d/M/yyyy H:m",
    "M/d/yy H:m",
    "d/M/yy H:m",
    "M/d/yyyy",
    "M/d/yy",
    "yyyy-M-d",
]
INFER_FORMATS = DATE_FORMATS + ["d/M/yyyy", "d/M/yy"]
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def time_key(day: Column, grain: str = "day") -> Column:
    """The text key of a date at a grain; NULL stays NULL."""
    if grain == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "week":
        # an ISO week belongs to the year of its Thursday
        thursday = F.date_add(day, F.lit(3) - F.weekday(day))
        return F.format_string("%04d-W%02d", F.year(thursday), F.weekofyear(day))
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
    if grain == "year":
        return F.date_format(day, "yyyy")
    if grain == "weekday":
        return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(day) + 1)
    raise ValueError(f"unknown time grain {grain!r}; choose from {GRAINS}")


def weekday(day: Column) -> Column:
    """Monday 0 ... Sunday 6."""
    return F.weekday(day)


def iso_time(text: Column) -> Column:
    """ISO text as a naive timestamp; an offset is dropped as written; NULL when it is not ISO."""
    bare = F.when(F.length(text) > 10, F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")).otherwise(text)
    return F.when(text.rlike(ISO_PATTERN), bare.try_cast("timestamp_ntz"))


def _shape(pattern: str) -> str:
    """The regular expression of the digit widths a Java pattern may hold."""
    parts = re.split(r"(yyyy|yy|M|d|H|m|s)", pattern)
    widths = {"yyyy": r"\d{4}", "yy": r"\d{2}"}
    return "^" + "".join(
        widths.get(p, r"\d{1,2}") if i % 2 else re.escape(p) for i, p in enumerate(parts)
    ) + "$"


def parse_time(text: Column, pattern: str) -> Column:
    """Text under one Java pattern as a naive timestamp; two-digit years 69..99 are 19xx."""
    value = F.when(text.rlike(_shape(pattern)), F.try_to_timestamp(text, F.lit(pattern))).cast("timestamp_ntz")
    if "yyyy" in pattern:
        return value
    return F.when(F.year(value) >= 2069, value - F.expr("INTERVAL '100' YEAR")).otherwise(value)


def time_value(text: Column, formats: list[str] | tuple[str, ...] = ()) -> Column:
    """The first fitting format, or ISO text when no format is given, as a naive timestamp."""
    if not formats:
        return iso_time(text)
    return F.coalesce(*[parse_time(text, f) for f in formats])
