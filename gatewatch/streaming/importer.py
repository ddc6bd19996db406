"""Continuous import of uploaded files with Structured Streaming.

The dashboard re-reads and merges every upload by hand; here a landing
folder is watched instead. The stream carries the names of new files, at most
``max_files`` a micro-batch. A micro-batch reads its files as the batch import
does (each by its own header, dates of merged cells filled in file order),
drops copies, leaves out what the stored table already holds (null-safe, on
all columns) and appends the rest. The result equals ``merge_import`` for a
table that has no copies of its own, without rewriting the table. Rows without
a valid date go to a table of rejects, names and headers of files without any
expected column to a table of rejected files beside it. Progress lives in the stream
checkpoint, so a restarted query neither loses nor repeats files.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import fill_dates, type_audit, type_flights
from ..operators.filters import in_range
from ..schemas import AUDIT_RAW, FLIGHT_RAW
from ..session import checkpoint_dir
from ..sources.readers import exact, foreign_files, read_upload, upper

#: What the file stream gives; the contents are not read by the stream itself.
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                      T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _same_row(left: DataFrame, right: DataFrame):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in left.columns])


def _only_new(batch: DataFrame, table: DataFrame | None, date_col: str) -> DataFrame:
    """Rows of the micro-batch that the table does not hold yet.

    Only stored rows in the batch's date range take part (a predicate that
    reaches the Parquet scan); the planner picks the join by the sizes.
    """
    batch = batch.dropDuplicates()
    if table is None:
        return batch
    near = table.where(in_range(table, batch, date_col))
    return batch.join(near, _same_row(batch, near), "left_anti")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if nothing has been written there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def merge_batch(batch: DataFrame, target_path: str, date_col: str = "audit_date") -> None:
    """Append the rows of ``batch`` that ``target_path`` does not hold yet.

    Idempotent: a micro-batch replayed after a failure finds its rows
    already stored and appends nothing.
    """
    table = _stored(batch.sparkSession, target_path)
    _only_new(batch, table, date_col).write.mode("append").parquet(target_path)


def read_batch(spark: SparkSession, paths: list[str], kind: str) -> tuple[DataFrame, str]:
    """Typed rows of the files, undated ones included, and the date column.
    Files that are no records of the kind are left out (``rejected_files``)."""
    if kind == "audit":
        raw = read_upload(spark, paths, AUDIT_RAW, key=upper, skip_foreign=True)
        return type_audit(raw.drop("source_file", "row_no")), "audit_date"
    raw = read_upload(spark, paths, FLIGHT_RAW, skip_foreign=True)
    return type_flights(fill_dates(raw, "row_no", "source_file")), "flight_date"


def rejected_files(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """The files that ``read_batch`` leaves out, with their headers."""
    schema, key = (AUDIT_RAW, upper) if kind == "audit" else (FLIGHT_RAW, exact)
    return foreign_files(spark, paths, schema, key=key)


def import_stream(spark: SparkSession, landing_dir: str, target_path: str,
                  checkpoint_location: str | None = None, kind: str = "audit",
                  available_now: bool = True, max_files: int = 100,
                  rejects_path: str | None = None) -> StreamingQuery:
    """Start the import query for ``kind`` 'audit' (pt-BR upload headers) or
    'flights' (flight-log CSV). Rejects go to ``rejects_path``, by default
    beside the target. The default checkpoint belongs to this landing folder
    and target alone."""
    rejects_path = rejects_path or f"{target_path.rstrip('/')}__rejects"
    files = (spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files)
             .load(landing_dir).select("path"))
    if checkpoint_location is None:
        own = hashlib.sha256(f"{landing_dir}\n{target_path}\n{kind}".encode()).hexdigest()[:16]
        checkpoint_location = f"{checkpoint_dir(spark).rstrip('/')}/import-{kind}-{own}"

    def run(batch: DataFrame, _epoch: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most max_files names
        if not paths:
            return
        foreign = rejected_files(batch.sparkSession, sorted(paths), kind)
        if not foreign.isEmpty():
            foreign.write.mode("overwrite").parquet(f"{rejects_path}__files/batch={_epoch}")
        typed, date_col = read_batch(batch.sparkSession, sorted(paths), kind)
        typed = typed.persist()
        try:
            merge_batch(typed.where(F.col(date_col).isNotNull()), target_path, date_col)
            lost = typed.where(F.col(date_col).isNull())
            if not lost.isEmpty():
                lost.withColumn("epoch", F.lit(_epoch)).write.mode("overwrite").parquet(f"{rejects_path}/batch={_epoch}")
        finally:
            typed.unpersist()

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
