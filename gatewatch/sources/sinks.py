"""Sinks: CSV export, table replace / append, snapshots, report lines.

Writes go through Spark's commit protocol, so a lost executor only retries
its tasks and readers never see half-written output. A table is replaced by a
finished copy that is moved into its place: the plan may read the table, its
order is kept, and a job that fails leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report_line
from ..operators.tables import apply_edits
from . import versions as V


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: header row, quotes doubled, multi-line fields kept."""
    (df.write.mode(mode).option("header", True)
       .option("quote", '"').option("escape", '"').option("quoteAll", False)
       .option("dateFormat", "yyyy-MM-dd")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)  # fields as they are
       .csv(path))


def _is_path(target: str) -> bool:
    return "/" in target or ":" in target


def replace_table(df: DataFrame, target: str, fmt: str = "parquet", versioned: bool = False) -> None:
    """K2: ``df`` becomes the contents of ``target`` (catalog table or path).

    A path that holds versions (``versions.py``), or is to hold them from now
    on (``versioned``), gets a new one, which readers see all at once; it is
    read by ``read_table``. Any other target is replaced as follows.

    ``df`` may read ``target``. It is written once, beside the target, in its
    own order; the finished copy is then moved into place and the old contents
    are removed. If the job fails, the target is untouched; if the driver dies
    between the two moves, both copies are still there under their own names.
    """
    mark = uuid.uuid4().hex[:12]
    if _is_path(target) and (versioned or V.is_versioned(df.sparkSession, target)):
        V.write_version(df, target)
    elif _is_path(target):
        _replace_path(df, target.rstrip("/"), mark, fmt)
    else:
        _replace_catalog_table(df, target, mark, fmt)


def _replace_path(df: DataFrame, target: str, mark: str, fmt: str) -> None:
    spark = df.sparkSession
    new, old = f"{target}__new_{mark}", f"{target}__old_{mark}"
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.mode("errorifexists").format(fmt).save(new)
        if store.exists(path(target)) and not store.rename(path(target), path(old)):
            raise OSError(f"cannot move {target} aside")
        if not store.rename(path(new), path(target)):
            raise OSError(f"cannot move {new} to {target}")
        store.delete(path(old), True)
    except Exception:
        if not store.exists(path(target)) and store.exists(path(old)):
            store.rename(path(old), path(target))
        store.delete(path(new), True)
        raise
    spark.catalog.refreshByPath(target)


def _replace_catalog_table(df: DataFrame, target: str, mark: str, fmt: str) -> None:
    spark = df.sparkSession
    new, old = f"{target}__new_{mark}", f"{target}__old_{mark}"
    try:
        df.write.mode("errorifexists").format(fmt).saveAsTable(new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    there = spark.catalog.tableExists(target)
    if there:
        spark.sql(f"ALTER TABLE {target} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {target}")
    if there:
        spark.sql(f"DROP TABLE {old}")


def store_by_month(df: DataFrame, path: str, date_col: str = "audit_date") -> None:
    """K2: a versioned table with a folder for each month, for ``save_edits``."""
    V.write_version(df, path, V.month_key(date_col))


def save_edits(spark: SparkSession, path: str, scope: Column, edited: DataFrame,
               date_col: str = "audit_date") -> list[str]:
    """U4: saves the edits of a filtered view in a table stored by month.

    Only the months that rows of the view or edited rows lie in are read,
    edited (``tables.apply_edits``), sorted and written; all other files stay.
    Rows of other months stay as they are stored, also those without a total.
    Readers see all of the edit or none of it. Raises ``versions.Conflict`` if
    the table was replaced since it was read. Gives the months.
    """
    held = V.contents(spark, path)
    if held is None:
        raise ValueError(f"{path} holds no version")
    key = V.month_key(date_col)
    dated = edited.where(F.col(date_col).isNotNull())  # others are dropped by the edit
    seen = V.read_version(spark, path, held=held).where(scope)
    months = sorted({*V.touched(seen, key), *V.touched(dated, key)})
    if not months:
        return []
    table = V.read_version(spark, path, held=held, keys=months)
    saved = apply_edits(table, scope, edited).select(*table.columns)
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (date_col, *[c for c in saved.columns if c != date_col])]
    V.write_partitions(saved, path, key, months, held, order)
    return months


def append_table(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """K3: append records."""
    writer = df.write.mode("append").format(fmt)
    if _is_path(target):
        writer.save(target)
    else:
        writer.saveAsTable(target)


def snapshot(df: DataFrame, base_path: str, label: str | None = None) -> str:
    """K4: backup copy of the table as Parquet under ``base_path/snapshot=<label>``."""
    label = label or uuid.uuid4().hex[:12]
    path = f"{base_path.rstrip('/')}/snapshot={label}"
    df.write.mode("errorifexists").parquet(path)
    return path


def export_report(df: DataFrame, path: str) -> None:
    """K5: the filtered report as CSV (dates as dd/MM/yyyy)."""
    out = df
    for name, dtype in df.dtypes:
        if dtype == "date":
            out = out.withColumn(name, F.date_format(name, "dd/MM/yyyy"))
    write_csv(out, path)


def report_lines(df: DataFrame, path: str | None = None) -> DataFrame:
    """K6: '<operator> - <flights> voos - <routes> rotas', one line per row;
    written as text when ``path`` is given."""
    lines = df.select(report_line("operator", "flights", "routes").alias("value"))
    if path:
        lines.write.mode("overwrite").text(path)
    return lines
