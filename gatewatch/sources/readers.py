"""Sources: CSV (with quoted newlines), delimiter sniffing, stored tables and
a first-available fallback chain.

Spreadsheet uploads are read from their CSV export (one directory per
import). Every file is read by its own header: delimiter and column order may
differ from file to file, and columns are matched by name. All fields are text
and cleaned by expressions, never with schema inference.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import is_versioned, read_version

# Delimiters tried in order when sniffing a header line.
DELIMITERS = [";", ",", "\t", "|"]


def _reader(spark: SparkSession, sep: str):
    return (spark.read.option("header", True)
            .option("multiLine", True)   # notes hold quoted newlines
            .option("quote", '"').option("escape", '"')
            .option("encoding", "UTF-8")
            .option("sep", sep)
            .option("mode", "PERMISSIVE"))


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Parquet with pushdown and pruning."""
    return spark.read.parquet(*([path] if isinstance(path, str) else list(path)))


def first_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file`` and ``header``, the first line, of every file that has a line.

    The number of each file's first line is the least of its lines in the
    block at the file's start, and a second look at the lines takes those by
    their numbers: numbers are grouped, lines are neither sorted nor shuffled.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n")).where("at = 0")
    first = lines.groupBy("file").agg(F.min("n").alias("n")).select("n")
    return lines.join(F.broadcast(first), "n").select("file", F.col("value").alias("header"))


def header_lines(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """The files of an import by their header line (the first line of a file).

    What comes to the driver is one line for each distinct header and the names
    of the files, which the driver lists for the scan anyway. Empty files have
    no header and hold no record.
    """
    found = first_lines(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {r.header.lstrip("﻿"): list(r.files) for r in sorted(found, key=lambda r: r.files[0])}


def exact(name: str) -> str:
    return name.strip()


def upper(name: str) -> str:
    """Headers as the audit module matches them."""
    return name.strip().upper()


def split_header(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), [])


def sniff_header(line: str) -> str:
    """The first delimiter that splits a header line into two columns or more."""
    return next((d for d in DELIMITERS if len(split_header(line, d)) >= 2), ",")


def sniff_delimiter(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The delimiter of an import whose files agree on it."""
    found = {sniff_header(h) for h in header_lines(spark, path)}
    if len(found) > 1:
        raise ValueError(f"the files of {path} use several delimiters: {sorted(found)}")
    return found.pop() if found else ","


def _layout(spark: SparkSession, line: str, files: list[str], sep: str | None,
            expected: Sequence[str] | None, key: Callable[[str], str], with_source: bool) -> DataFrame:
    """The files of one header, their columns by name."""
    sep = sep or sniff_header(line)
    names = split_header(line, sep)
    at: dict[str, int] = {}
    for k, name in enumerate(names):
        at.setdefault(key(name), k)  # of equal names the first counts
    raw = _reader(spark, sep).schema(T.StructType(
        [T.StructField(f"_{k}", T.StringType()) for k in range(len(names))])).csv(files)
    if expected is None:
        cols = [F.col(f"_{k}").alias(n) for n, k in at.items()]
    else:
        if not any(key(c) in at for c in expected):
            raise ValueError(f"none of the columns {list(expected)} is in the header {line!r} of {files[0]}")
        cols = [(F.col(f"_{at[key(c)]}") if key(c) in at else F.lit(None).cast("string")).alias(c) for c in expected]
    extra = [F.col("_metadata.file_path").alias("source_file")] if with_source else []
    return raw.select(*cols, *extra)


def _is_foreign(line: str, sep: str | None, expected: Sequence[str], key: Callable[[str], str]) -> bool:
    """Whether a header names none of the expected columns."""
    return {key(c) for c in expected}.isdisjoint(key(c) for c in split_header(line, sep or sniff_header(line)))


def foreign_files(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str | None = None,
                  key: Callable[[str], str] = exact) -> DataFrame:
    """The files of an import whose header names no column of ``schema``, as
    ``source_file`` and ``header``: what ``skip_foreign`` leaves out."""
    rows = [(f, h) for h, files in header_lines(spark, path).items()
            if _is_foreign(h, sep, schema.names, key) for f in files]
    return spark.createDataFrame(rows, "source_file string, header string")


def _by_header(spark: SparkSession, path, sep, expected, key, with_source, skip_foreign=False) -> DataFrame:
    parts = [_layout(spark, h, files, sep, expected, key, with_source)
             for h, files in header_lines(spark, path).items()
             if not (skip_foreign and expected is not None and _is_foreign(h, sep, expected, key))]
    if not parts:
        names = [*(expected or []), *(["source_file"] if with_source else [])]
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
             sep: str | None = ",", with_source: bool = False, key: Callable[[str], str] = exact,
             skip_foreign: bool = False) -> DataFrame:
    """CSV with a header row and quoted multi-line fields, all text.

    With ``schema`` its columns are looked up in each file's header by name
    (``key`` of it); a column that a file lacks is null, a file with none of
    them is an error, or left out with ``skip_foreign`` (``foreign_files``
    lists these). Without it a file's own columns are read. ``sep=None``
    sniffs the delimiter of each file. A multi-line CSV file is not
    splittable, so an import is expected as many files in one directory.
    ``with_source`` adds ``source_file`` (for per-file forward fill).
    """
    return _by_header(spark, path, sep, schema.names if schema is not None else None, key, with_source, skip_foreign)


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                   with_source: bool = False, key: Callable[[str], str] = exact,
                   skip_foreign: bool = False) -> DataFrame:
    """CSV whose files use ';', ',', tab or '|', each its own
    (spreadsheet exports)."""
    return read_csv(spark, path, schema, None, with_source, key, skip_foreign)


def read_upload(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                key: Callable[[str], str] = exact, skip_foreign: bool = False) -> DataFrame:
    """An import folder of spreadsheet exports, all text, with ``source_file``
    and ``row_no`` (row order within its file) for file-order operations such
    as filling merged cells.

    A multi-line CSV file is read by one task, in file order, so the
    partition-local ids increase with the row order inside each file.
    """
    df = read_delimited(spark, path, schema, True, key, skip_foreign)
    return df.withColumn("row_no", F.monotonically_increasing_id())


def read_table(spark: SparkSession, name: str, fallback_first: bool = True) -> DataFrame:
    """S3: a stored table by name (case-insensitive in the catalog); a path
    is read as Parquet, in its last version if it has versions. With ``fallback_first`` an unknown name falls back
    to the first table of the current database."""
    if "/" in name or name.startswith("file:"):
        return read_version(spark, name) if is_versioned(spark, name) else spark.read.parquet(name)
    if spark.catalog.tableExists(name):
        return spark.read.table(name)
    if fallback_first:
        tables = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
        if tables:
            return spark.read.table(sorted(tables)[0])
    raise ValueError(f"table {name} not found")


def read_first(spark: SparkSession, readers: Sequence[Callable[[], DataFrame]],
               schema: T.StructType) -> DataFrame:
    """The first source that is there and not empty, else a typed empty
    frame. ``isEmpty`` is a one-row probe, not a scan. A source is not there if
    its path or table is not found; any other failure is raised."""
    for read in readers:
        try:
            df = read()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        if df is not None and not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)
