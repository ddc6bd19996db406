"""Ordered reports: detail tables, save order, occurrence detail, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import DEFAULT_RULES, Rules
from .cleaning import with_retention
from .metrics import with_category


#: Copies of a row that share their last sort key.
CHUNK = 100_000


def _sorted(df: DataFrame, *keys) -> DataFrame:
    """``df`` in the order of ``keys``, identical rows side by side.

    A range partitioner cannot split equal keys, and copies may hold a large
    share of the rows. So the copies of a row that come from one partition are
    numbered, and every ``CHUNK`` of them get a last sort key of their own, by
    which they spread over as many ranges as they need. Rows are numbered by
    sorting one long, so no task holds its rows in a table of groups beside
    what ``df`` holds itself. Which copy has which number makes no difference,
    so nothing depends on the order in which a task sees its rows, and a task
    that runs again gives the same ranges.

    The range partitioner sends sampled keys to the driver: ``keys`` are short.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumn("__mark", F.xxhash64(F.spark_partition_id(), *columns))
    number = F.row_number().over(Window.partitionBy("__mark").orderBy("__mark"))
    chunks = marked.withColumn("__chunk", F.floor((number - 1) / CHUNK))
    return chunks.orderBy(*keys, "__mark", "__chunk").select(*columns)


def detail(df: DataFrame) -> DataFrame:
    """O1: detail table (with row total and retention) by date, carrier.

    Remaining columns break ties so the range partitioner can split a hot
    (date, carrier) pair across tasks.
    """
    out = with_retention(df)
    first = ["audit_date", "carrier", "operation", "released", "retained"]
    rest = [c for c in out.columns if c not in first]
    return _sorted(out, *[F.col(f"`{c}`").asc_nulls_first() for c in (*first, *rest)])


def sort_for_save(df: DataFrame, date_col: str = "audit_date") -> DataFrame:
    """O2: table in date order before persisting.

    A global sort on the date plus every other column as tie-breakers, so
    the range partitioner can split a hot date across output files.
    """
    others = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if c != date_col]
    return _sorted(df, F.col(date_col).asc_nulls_first(), *others)


def occurrence_detail(df: DataFrame, rules: Rules = DEFAULT_RULES,
                      text_col: str = "notes", date_col: str = "flight_date") -> DataFrame:
    """O3: date, operator, category, note of every categorised note, by date.

    Within a category notes are in the order of two independent hashes, equal
    notes side by side: no two long notes are compared to sort them, and none
    is among the keys that go to the driver to find the ranges.
    """
    cat = with_category(df.where(F.col(text_col).isNotNull()), rules, text_col)
    found = cat.where(F.col("category").isNotNull()).select(date_col, "operator", "category", text_col)
    return _sorted(found, date_col, "operator", "category", F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col))


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in file order."""
    return df.orderBy(order_by).limit(n)
