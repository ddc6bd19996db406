"""Registered queries of the sources and sinks: each writes a given table
under the shared scratch folder and gives back what is read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import filters as FL
from ..operators import ordering as O
from ..operators import tables as TB
from ..schemas import AUDIT_RAW, FLIGHT_COLUMNS, FLIGHT_HEADERS, FLIGHT_RAW, FLIGHTS
from ..session import scratch_path
from ..sources import (append_table, drop_old_versions, export_report, read_csv, read_delimited, read_first, read_parquet,
                       read_table, replace_table, report_lines, save_edits, snapshot, store_by_month, stored_bounds, write_csv)
from ..sources.readers import upper
from . import adapters as AD

from .oracle import with_views


def _new(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The flight log under its file's headers, all text, operators padded."""
    f = C.with_storage_dates(AD.flights(spark, sf)).withColumn("operator", F.concat(F.lit("  "), "operator", F.lit(" ")))
    return f.select(*[F.col(c).cast("string").alias(h) for h, c in FLIGHT_HEADERS.items()])


_LOG = """SELECT strftime(flight_date, '%d/%m/%Y') AS "Data", '  ' || operator || ' ' AS "Operador", shift_type AS "Tipo",
       CAST(routes AS VARCHAR) AS "Rotas", CAST(flights AS VARCHAR) AS "Voos", notes AS "Obs" FROM flights"""


def _csv(spark, sf):
    path = _new(spark, "csv")
    write_csv(_log(spark, sf), path)
    return read_csv(spark, path, FLIGHT_RAW)


def _delimited(spark, sf):
    """One folder with files of two delimiters and two column orders."""
    path, log = _new(spark, "delimited"), _log(spark, sf)
    reserve = F.col("Tipo") == "RESERVA"
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    log.where(~reserve).write.options(sep=";", **plain).csv(path)
    log.where(reserve).select(*reversed(log.columns)).write.mode("append").options(sep=",", **plain).csv(path)
    return read_delimited(spark, path, FLIGHT_RAW)


def _spreadsheet(spark, sf):
    """A sheet's export: other column order, headers as people type them, no total."""
    path = _new(spark, "sheet")
    raw = AD.audit_raw(spark, sf).drop("src_order", "src_line")
    raw.select(*reversed(raw.columns)).write.options(header=True, sep="\t", ignoreLeadingWhiteSpace=False,
                                                     ignoreTrailingWhiteSpace=False).csv(path)
    return C.clean_audit(read_delimited(spark, path, AUDIT_RAW, key=upper))


def _stored(spark, sf, name) -> str:
    path = _new(spark, name)
    AD.audit(spark, sf).write.parquet(path)
    return path


def _replace(spark, sf):
    """A table replaced by a plan that reads it, in date order."""
    path = _stored(spark, sf, "replaced")
    replace_table(O.sort_for_save(read_parquet(spark, path).where("released > 0")), path)
    return read_parquet(spark, path)


def _versions(spark, sf):
    """A versioned table, replaced twice by plans that read it; the first
    version is gone afterwards."""
    path = _new(spark, "versioned")
    replace_table(AD.audit(spark, sf), path, versioned=True)
    replace_table(read_table(spark, path).where("released > 0"), path)
    replace_table(O.sort_for_save(read_table(spark, path).where("retained > 0")), path)
    drop_old_versions(spark, path, keep=1, older_than=0)
    return read_table(spark, path)


#: A view of three months whose urgent rows are moved to other months, whose low
#: ones are deleted, and whose other rows get one more retained.
_SCOPE = "audit_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND released > 0"


def _edits_by_month(spark, sf):
    path = _new(spark, "by-month")
    store_by_month(AD.audit_with_ids(spark, sf), path)
    urgent = F.col("operation") == "1-URGENT"
    edited = read_table(spark, path).where(_SCOPE).where("operation <> '5-LOW'").withColumns({
        "audit_date": F.when(urgent, F.date_add("audit_date", 400)).otherwise(F.col("audit_date")),
        "retained": F.when(urgent, F.col("retained")).otherwise(F.col("retained") + 1)})
    save_edits(spark, path, F.expr(_SCOPE), edited)
    return read_table(spark, path)


_EDITED = f"""
SELECT audit_date, carrier, operation, released, retained, released + retained AS total, row_id
FROM audit_ids WHERE NOT ({_SCOPE})
UNION ALL SELECT CASE WHEN operation = '1-URGENT' THEN audit_date + 400 ELSE audit_date END, carrier, operation, released, r,
       released + r, row_id
FROM (SELECT *, CASE WHEN operation = '1-URGENT' THEN retained ELSE retained + 1 END AS r FROM audit_ids
      WHERE ({_SCOPE}) AND operation <> '5-LOW')"""


def _stored_bounds(spark, sf):
    """The last five days of a table by month; the bounds of its dates come from
    the files' footers, and the filter on them leaves other months unread."""
    path = _new(spark, "bounds")
    store_by_month(AD.audit(spark, sf), path)
    return FL.last_data_days(read_table(spark, path), 5, bounds=stored_bounds(spark, path, "audit_date"))


def _replace_import(spark, sf):
    """An import that replaces the stored flight log."""
    path = _new(spark, "log")
    AD.flights(spark, sf).write.parquet(path)
    new = C.import_flights(AD.flights_raw(spark, sf), order_by="row_no", file_col="file_id")
    replace_table(TB.replace_import(new), path)
    return read_parquet(spark, path)


def _append(spark, sf):
    path = _stored(spark, sf, "appended")
    append_table(AD.audit(spark, sf).where("retained > 0"), path)
    return read_parquet(spark, path)


def _snapshot(spark, sf):
    return read_table(spark, snapshot(AD.flights(spark, sf), _new(spark, "backup"), "today"))


def _export(spark, sf):
    path = _new(spark, "report")
    export_report(AD.audit(spark, sf).where("retained > 0"), path)
    return read_csv(spark, path)


def _first(spark, sf):
    path = _new(spark, "fallback")
    AD.flights(spark, sf).write.parquet(path)
    return read_first(spark, [lambda: spark.read.parquet(_new(spark, "missing")),
                              lambda: read_parquet(spark, path).where("false"),
                              lambda: read_parquet(spark, path)], FLIGHTS)


def _lines(spark, sf):
    path = _new(spark, "lines")
    report_lines(AD.flights(spark, sf), path)
    return spark.read.text(path)


_TEXT = "CAST({0} AS VARCHAR) AS {0}"

#: (name, covered ids, builder, SQL)
QUERIES = [
    ("io_csv_round_trip", ("S1", "K1"), _csv, with_views(_LOG, "flights")),
    ("io_delimited_folder", ("S2",), _delimited, with_views(_LOG, "flights")),
    ("io_spreadsheet_import", ("S5", "P1", "P10"), _spreadsheet, with_views(
        "SELECT * FROM audit_typed WHERE audit_date IS NOT NULL", "audit_typed")),
    ("io_replace_table", ("K2", "O2"), _replace, with_views("SELECT * FROM audit WHERE released > 0", "audit")),
    ("io_versioned_replace", ("K2", "S3"), _versions, with_views(
        "SELECT * FROM audit WHERE released > 0 AND retained > 0", "audit")),
    ("io_edit_by_month", ("U4", "K2"), _edits_by_month, with_views(_EDITED, "audit_ids")),
    ("io_stored_bounds", ("D4", "F8", "K2"), _stored_bounds, with_views(
        "SELECT * FROM audit WHERE audit_date >= (SELECT greatest(max(audit_date) - 4, min(audit_date)) FROM audit)", "audit")),
    ("io_replace_import", ("U5", "K2"), _replace_import, with_views(
        f"SELECT {', '.join(FLIGHT_COLUMNS)} FROM flights_imported", "flights_imported")),
    ("io_append_table", ("K3",), _append, with_views(
        "SELECT * FROM audit UNION ALL SELECT * FROM audit WHERE retained > 0", "audit")),
    ("io_snapshot", ("K4", "S3"), _snapshot, with_views("SELECT * FROM flights", "flights")),
    ("io_export_report", ("K5",), _export, with_views(
        "SELECT strftime(audit_date, '%d/%m/%Y') AS audit_date, carrier, operation, "
        + ", ".join(_TEXT.format(c) for c in ("released", "retained", "total")) + " FROM audit WHERE retained > 0", "audit")),
    ("io_first_source", ("S4",), _first, with_views("SELECT * FROM flights", "flights")),
    ("io_report_lines", ("K6",), _lines, with_views(
        "SELECT COALESCE(operator, 'Não Informado') || ' - ' || CAST(flights AS VARCHAR) || ' voos - ' || CAST(routes AS VARCHAR) "
        "|| ' rotas' AS value FROM flights", "flights")),
]

__all__ = ["QUERIES"]
