"""Filters and distinct value lists.

Conventions: ``None`` for a selection means "everything" (no predicate), an
empty list selects nothing. Predicates stay on the plain date column so that
they reach the Parquet scan. Bounds that depend on the data (latest day,
current week, last N days of data) are scalar subqueries: one small
aggregate evaluated once, never a join or a driver round trip.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def _all(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def in_selection(col: str, values) -> Column | None:
    """Membership predicate; None = no predicate; [] = nothing."""
    if values is None:
        return None
    values = list(values)
    if not values:
        return F.lit(False)
    return F.col(col).isin(*values)


def years_predicate(col: str, years) -> Column | None:
    """Year membership as an OR of date ranges, so it prunes Parquet row groups."""
    if years is None:
        return None
    years = sorted({int(y) for y in years})
    if not years:
        return F.lit(False)
    ranges = [(F.col(col) >= _date(_dt.date(y, 1, 1))) & (F.col(col) < _date(_dt.date(y + 1, 1, 1)))
              for y in years]
    return reduce(lambda a, b: a | b, ranges)


def audit_predicate(years=None, start=None, end=None, operations=None, carriers=None,
                    date_col: str = "audit_date") -> Column:
    preds = [p for p in (
        years_predicate(date_col, years),
        F.col(date_col) >= _date(start) if start is not None else None,
        F.col(date_col) <= _date(end) if end is not None else None,
        in_selection("operation", operations),
        in_selection("carrier", carriers),
    ) if p is not None]
    return _all(preds)


# ---------------------------------------------------------------- audit filters

def filter_audit(df: DataFrame, years=None, start=None, end=None,
                 operations=None, carriers=None) -> DataFrame:
    """year list AND date range (end day included) AND operation list AND
    carrier list."""
    return df.where(audit_predicate(years, start, end, operations, carriers))


def previous_window(start, end) -> tuple[_dt.date, _dt.date]:
    """Equal-length period just before [start, end]."""
    s, e = _dt.date.fromisoformat(str(start)), _dt.date.fromisoformat(str(end))
    n = (e - s).days + 1
    return s - _dt.timedelta(days=n), s - _dt.timedelta(days=1)


def previous_period(df: DataFrame, start, end, operations=None, carriers=None) -> DataFrame:
    """previous period with the operation and carrier filters but not the
    year filter."""
    ps, pe = previous_window(start, end)
    return df.where(audit_predicate(None, ps, pe, operations, carriers))


def _of_bounds(df: DataFrame, date_col: str, bounds, value) -> Column:
    """``value(first, last)`` of the data's dates: of ``bounds`` where the caller
    knows them (``sources.stored_bounds``), else by a scalar subquery over ``df``."""
    if bounds is None:
        return df.select(value(F.min(date_col), F.max(date_col))).scalar()
    return value(*[F.lit(None).cast("date") if b is None else _date(b) for b in bounds])


def last_data_days(df: DataFrame, days: int = 5, date_col: str = "audit_date", bounds=None) -> DataFrame:
    """F8: the last ``days`` days of data: from max(max_date - (days-1), min_date)."""
    start = _of_bounds(df, date_col, bounds, lambda low, high: F.greatest(F.date_sub(high, days - 1), low))
    return df.where(F.col(date_col) >= start)


def current_week(df: DataFrame, date_col: str = "audit_date", bounds=None) -> DataFrame:
    """Monday of the latest week with data, up to the latest date."""
    week_start = _of_bounds(df, date_col, bounds, lambda low, high: F.to_date(F.date_trunc("week", high)))
    return df.where(F.col(date_col) >= week_start)


def single_day(df: DataFrame, day=None, operations=None, carriers=None,
               date_col: str = "audit_date", bounds=None) -> DataFrame:
    """one day (default: the latest), keeping only the operation and
    carrier filters. ``bounds`` are those of ``df``; under a selection the
    latest day is that of the selected rows, so they are not used."""
    base = df.where(audit_predicate(None, None, None, operations, carriers, date_col))
    known = bounds if operations is None and carriers is None else None
    target = _date(day) if day is not None else _of_bounds(base, date_col, known, lambda low, high: high)
    return base.where(F.col(date_col) == target)


def last_months(df: DataFrame, n: int = 3, months=None, month_col: str = "year_month") -> DataFrame:
    """rows of the ``n`` latest distinct months, or of the given months
    (an empty list means all)."""
    if months is not None:
        months = list(months)
        return df if not months else df.where(F.col(month_col).isin(*months))
    latest = (df.select(month_col).where(F.col(month_col).isNotNull()).distinct()
              .orderBy(F.col(month_col).desc()).limit(n))
    # ``latest`` holds at most n rows, so broadcasting it is size-bounded.
    return df.join(F.broadcast(latest), on=month_col, how="left_semi")


def in_range(old: DataFrame, new: DataFrame, date_col: str) -> Column:
    """Condition on ``old``: the row's date lies within those of ``new``, or it
    has none. Bounds are scalar subqueries; the predicate reaches the scan."""
    low, high = new.select(F.min(date_col)).scalar(), new.select(F.max(date_col)).scalar()
    day = F.col(date_col)
    return day.isNull() | F.coalesce(day.between(low, high), F.lit(False))


# ---------------------------------------------------------------- flight filters

def filter_operators(df: DataFrame, operators=None) -> DataFrame:
    """operator selection; an empty selection gives an empty frame."""
    pred = in_selection("operator", operators)
    return df if pred is None else df.where(pred)


def filter_dates(df: DataFrame, start, end=None, date_col: str = "flight_date") -> DataFrame:
    """inclusive range, or one day when only ``start`` is given."""
    if end is None:
        return df.where(F.col(date_col) == _date(start))
    return df.where(F.col(date_col).between(_date(start), _date(end)))


def last_days(df: DataFrame, as_of, days: int, date_col: str = "flight_date") -> DataFrame:
    """[as_of - days, as_of], both ends included."""
    a = _dt.date.fromisoformat(str(as_of))
    return df.where(F.col(date_col).between(_date(a - _dt.timedelta(days=days)), _date(a)))


def filter_year(df: DataFrame, year=None, date_col: str = "flight_date") -> DataFrame:
    """one year, or everything when ``year`` is None."""
    if year is None:
        return df
    return df.where(years_predicate(date_col, [year]))


def timeline(df: DataFrame, as_of, days: int = 90, date_col: str = "flight_date", bounds=None) -> DataFrame:
    """default slider window of the occurrence analysis.

    Bounds come from the data: if min >= max then min = max - 1; the window
    starts at ``as_of - days`` when that lies inside [min, max], else at min,
    and ends at max.
    """
    a = _dt.date.fromisoformat(str(as_of))
    cand = _date(a - _dt.timedelta(days=days))

    def begin(low: Column, high: Column) -> Column:
        low = F.when(low >= high, F.date_sub(high, 1)).otherwise(low)
        return F.when((cand >= low) & (cand <= high), cand).otherwise(low)

    start = _of_bounds(df, date_col, bounds, begin)
    return df.where(F.col(date_col) >= start)  # no dated row is later than the last


def with_notes(df: DataFrame, notes_col: str = "notes") -> DataFrame:
    """rows that have a note."""
    return df.where(F.col(notes_col).isNotNull())


def month_of(df: DataFrame, as_of, date_col: str = "flight_date") -> DataFrame:
    """the calendar month of ``as_of`` in any year."""
    a = _dt.date.fromisoformat(str(as_of))
    return df.where(F.month(date_col) == F.lit(a.month))


# ---------------------------------------------------------------- distinct lists

def years(df: DataFrame, date_col: str = "audit_date") -> DataFrame:
    """Distinct years, newest first."""
    return (df.select(F.year(date_col).alias("year")).where(F.col("year").isNotNull())
              .distinct().orderBy(F.col("year").desc()))


def values(df: DataFrame, col: str, sort: bool = True) -> DataFrame:
    """Distinct values of a column (null kept, listed first)."""
    out = df.select(col).distinct()
    return out.orderBy(F.col(col).asc_nulls_first()) if sort else out


def date_bounds(df: DataFrame, as_of, date_col: str = "audit_date", bounds=None) -> DataFrame:
    """One row (min_date, max_date), falling back to ``as_of`` when empty."""
    a = _date(as_of)
    if bounds is not None:
        low, high = (a if b is None else _date(b) for b in bounds)
        return df.sparkSession.range(1).select(low.alias("min_date"), high.alias("max_date"))
    return df.agg(F.coalesce(F.min(date_col), a).alias("min_date"),
                  F.coalesce(F.max(date_col), a).alias("max_date"))
