"""Table maintenance: merge with exact dedupe, replace, append, scoped edits.

These build the new table contents lazily; persisting is the job of
``gatewatch.sources.sinks``. One rule holds for ``total`` wherever audit rows
enter or stay (``cleaning.with_total``), so that sums over it are sums over
all rows and a repeated import finds its rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import with_total
from .filters import in_range
from .ordering import sort_for_save


def _totalled(df: DataFrame) -> DataFrame:
    return with_total(df) if {"total", "released", "retained"} <= set(df.columns) else df


def merge_import(old: DataFrame | None, new: DataFrame, date_col: str | None = None) -> DataFrame:
    """Union + exact dedupe over all columns (nulls compare equal).

    The dedupe is a hash aggregate with a map-side partial step, so a group
    of many identical copies collapses inside each task before the shuffle.
    A first load (no old table) keeps the import as it is.

    With ``date_col`` only stored rows in the import's date range are
    compared; the others pass through without a shuffle. That is the full
    result if the stored table holds no copies of its own, as after one merge
    without ``date_col``.
    """
    if old is None:
        return _totalled(new)
    old, new = _totalled(old), _totalled(new)
    if date_col is None:
        return old.unionByName(new, allowMissingColumns=True).dropDuplicates()
    near = in_range(old, new, date_col)
    # rows without a date are few and are compared as well
    met = old.where(near).unionByName(new, allowMissingColumns=True).dropDuplicates()
    return old.where(~near).unionByName(met, allowMissingColumns=True)


def replace_import(new: DataFrame) -> DataFrame:
    """The import becomes the whole table."""
    return new


def append(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Add records, duplicates kept."""
    return _totalled(old).unionByName(_totalled(rows), allowMissingColumns=True)


def apply_edits(table: DataFrame, scope: Column | DataFrame, edited: DataFrame,
                key: str = "row_id", sort: bool = True) -> DataFrame:
    """U4: edit save. Rows of the filtered view that was edited are removed
    from ``table`` and replaced by ``edited`` (which may update, insert or
    delete rows). Edited rows without a date are dropped, their missing
    counts are 0 and their total is released + retained; rows outside the
    view stay as they are but for a missing total. Sorted for saving.

    ``scope`` is the view's predicate, which needs no join; or an explicit
    list of ids (a frame with ``key``), which is taken out by an anti join.
    """
    if isinstance(scope, Column):
        kept = table.where(~F.coalesce(scope, F.lit(False)))
    else:
        kept = table.join(scope.select(key), on=key, how="left_anti")
    edited = edited.where(F.col("audit_date").isNotNull())
    edited = edited.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("released", "retained")})
    edited = edited.withColumn("total", F.col("released") + F.col("retained"))
    out = with_total(kept).unionByName(edited, allowMissingColumns=True)
    return sort_for_save(out) if sort else out
