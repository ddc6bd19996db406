"""First and last date of a stored table from the footers of its files.

A Parquet file keeps the least and the greatest value of each column beside its
data. Spark answers MIN and MAX from these alone when the aggregate is pushed
into its file scan, which only the second version of that scan does; so it is
asked for here, and for this one read. Filters that start from the bounds of the
data (``last_data_days``, ``current_week``, ``single_day``, ``timeline``,
``date_bounds``) take the result as ``bounds`` and need no pass over the dates.

Files without statistics are read instead. Nulls are left out, as by MIN and
MAX; a table without a date has the bounds (None, None).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import is_versioned, read_version

_FIRST_VERSION_ONLY = "spark.sql.sources.useV1SourceList"
_PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


@contextmanager
def _footers_answer(spark: SparkSession) -> Iterator[None]:
    """Parquet reads that begin and run in here push aggregates into the scan."""
    before = {k: spark.conf.get(k) for k in (_FIRST_VERSION_ONLY, _PUSHDOWN)}
    others = [s for s in before[_FIRST_VERSION_ONLY].split(",") if s.strip().lower() != "parquet"]
    spark.conf.set(_FIRST_VERSION_ONLY, ",".join(others))
    spark.conf.set(_PUSHDOWN, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ends(df: DataFrame, date_col: str) -> DataFrame:
    return df.agg(F.min(date_col).alias("low"), F.max(date_col).alias("high"))


def _folders(spark: SparkSession, table: DataFrame) -> list[str]:
    """The folders of a table's files; their names are known to the driver from planning the scan."""
    return sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()})


def footer_ends(spark: SparkSession, paths: Sequence[str], date_col: str) -> DataFrame:
    """One row (low, high) whose plan reads footers alone; to be run inside ``_footers_answer``."""
    only = T.StructType([T.StructField(date_col, T.DateType())])
    return _ends(spark.read.schema(only).parquet(*paths), date_col)


def stored_bounds(spark: SparkSession, path: str, date_col: str) -> tuple[_dt.date | None, _dt.date | None]:
    """First and last date of the table at ``path`` (in its last version, if it has versions)."""
    table = read_version(spark, path) if is_versioned(spark, path) else spark.read.parquet(path)
    if not isinstance(table.schema[date_col].dataType, T.DateType):
        return tuple(_ends(table, F.to_date(date_col)).first())
    folders = _folders(spark, table)
    if not folders:
        return None, None
    try:
        with _footers_answer(spark):
            return tuple(footer_ends(spark, folders, date_col).first())
    except (Py4JJavaError, PySparkException) as e:
        if "statistics" not in str(e).lower() and "min/max" not in str(e).lower():
            raise
    return tuple(_ends(table, date_col).first())
