"""Date parsing and formatting for day-first (Brazilian) data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, unicode_trim

# Spreadsheet serial dates count days from this origin.
EXCEL_ORIGIN = "1899-12-30 00:00:00"
# Largest serial that still lands before year 10000, the last year of a date.
_MAX_SERIAL = 2958465

# Day first, set apart by slash, dash or point, with an optional time of day.
_TIME = r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?"
DAY_FIRST = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})" + _TIME + "$"
# Two-digit years from here on belong to the 1900s, the others to the 2000s.
PIVOT = "69"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
_SERIAL = r"^[0-9]+([.][0-9]+)?$"


def _day_first(text: Column) -> Column:
    """Year, month and day change places; two-digit years get their century."""
    day = F.regexp_replace(text, DAY_FIRST, "$3-$2-$1")
    century = F.when(day >= PIVOT, F.lit("19")).otherwise(F.lit("20"))
    full = F.when(F.substring(day, 3, 1) == "-", F.concat(century, day)).otherwise(day)
    return F.when(text.rlike(DAY_FIRST), full.try_cast("date"))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(_ISO), F.substring(text, 1, 10).try_cast("date"))


def _serial(text: Column) -> Column:
    number = F.when(text.rlike(_SERIAL), text.try_cast("double"))
    return F.when(
        number <= F.lit(_MAX_SERIAL),
        F.to_date(F.timestamp_add(
            "SECOND", F.round(number * 86400).cast("long"),
            F.lit(EXCEL_ORIGIN).cast("timestamp_ntz"))),
    )


def br_text(c) -> Column:
    """What ``date_of_br_text`` reads."""
    return unicode_trim(col_of(c).cast("string"))


def robust_text(c) -> Column:
    """What ``date_of_robust_text`` reads: trimmed, and the impossible '31/09'
    made '30/09'."""
    return F.replace(br_text(c), F.lit("31/09"), F.lit("30/09"))


def date_of_br_text(text: Column) -> Column:
    return F.coalesce(_day_first(text), _iso(text))


def date_of_robust_text(text: Column) -> Column:
    return F.coalesce(_day_first(text), _iso(text), _serial(text))


def parse_date_br(c) -> Column:
    """Day-first text ('d/M/yyyy', also with '-' or '.', two-digit years and a
    time) or ISO text to date; anything else -> null."""
    return date_of_br_text(br_text(c))


def parse_date_robust(c) -> Column:
    """Audit dates as typed by people and spreadsheets.

    Trim, fix the impossible '31/09' to '30/09', then per row the first that
    parses of: day-first text as in ``parse_date_br``, ISO 'yyyy-MM-dd[ time]',
    or a spreadsheet serial (days since 1899-12-30, fraction = time of day).
    """
    return date_of_robust_text(robust_text(c))


def format_date_br(c) -> Column:
    """Date -> 'dd/MM/yyyy' text, the storage format of the flight log."""
    return F.date_format(col_of(c), "dd/MM/yyyy")
