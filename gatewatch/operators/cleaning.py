"""Cleaning and projection: raw text records -> typed audit / flight tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (blank_to_null, clean_operator, format_date_br, label_int, label_pct,
                         retention_rate)
from ..functions.dates import br_text, date_of_br_text, date_of_robust_text, robust_text
from ..functions.numbers import number_of_br_text, number_of_text
from ..functions.text import normalize_header, parsed_once, unicode_trim
from ..schemas import (AUDIT_COLUMNS, AUDIT_HEADERS, FLIGHT_COLUMNS, FLIGHT_HEADERS,
                       OPERATIONS, SHIFT_TYPES)

# Monday-first weekday order used by the heat map.
WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


# ---------------------------------------------------------------- headers

def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip and upper-case every column name (metadata only, no data pass)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def select_expected(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Keep the expected columns that are present, in expected order."""
    present = [c for c in expected if c in df.columns]
    if not present:
        raise ValueError(f"none of the expected columns {list(expected)} is present")
    return df.select(*present)


# ---------------------------------------------------------------- audit

DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _trimmed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of ``df`` behind a barrier: texts are trimmed once, and the
    patterns that they are tried with see plain columns."""
    return parsed_once(df.select(*[c.alias(n) for n, c in columns.items()]))


def with_total(df: DataFrame) -> DataFrame:
    """The one rule for ``total``, at import, append and edit: where there is
    none, it is released + retained."""
    return df.withColumn("total", F.coalesce("total", F.col("released") + F.col("retained")))


def type_audit(raw: DataFrame) -> DataFrame:
    """Raw audit upload -> typed columns with build names; undated rows kept
    (``audit_date`` null) so that ``split_invalid`` can report them. A missing
    or blank total follows ``with_total``. Every text is parsed once, whatever
    is filtered on later."""
    df = normalize_headers(raw)
    numbers = ("released", "retained", "total")
    texts, out = {}, []
    for src, dst in AUDIT_HEADERS.items():
        if src not in df.columns:
            if dst != "total":
                raise ValueError(f"missing audit column {src}")
            out.append(F.lit(None).cast("double").alias(dst))
            continue
        kind, c = df.schema[src].dataType, F.col(dst)
        if dst == "audit_date":
            texts[dst] = F.to_date(src) if isinstance(kind, DATED) else robust_text(src)
            out.append(c if isinstance(kind, DATED) else date_of_robust_text(c).alias(dst))
        elif dst in numbers:
            text = isinstance(kind, T.StringType)
            texts[dst] = unicode_trim(src) if text else F.col(src).cast("double")
            value = number_of_br_text(c) if text else F.coalesce(c, F.lit(0.0))
            # a total that is not given is left to the rule for totals
            given = (c != "") if text else c.isNotNull()
            out.append((F.when(given, value) if dst == "total" else value).alias(dst))
        else:
            texts[dst] = F.col(src).cast("string")
            out.append(c)
    if "ROW_ID" in df.columns:
        texts["row_id"] = F.col("ROW_ID")
        out.append(F.col("row_id"))
    return parsed_once(with_total(_trimmed(df, texts).select(*out)))


def split_invalid(typed: DataFrame, date_col: str = "audit_date") -> tuple[DataFrame, DataFrame]:
    """(valid rows, one-row summary of rejected rows and their lost volume)."""
    invalid = F.col(date_col).isNull()
    valid = typed.where(F.col(date_col).isNotNull())
    summary = typed.agg(
        F.count_if(invalid).cast("long").alias("rejected_rows"),
        F.coalesce(F.sum(F.when(invalid, F.col("released") + F.col("retained"))),
                   F.lit(0.0)).alias("lost_volume"),
    )
    return valid, summary


def clean_audit(raw: DataFrame) -> DataFrame:
    """Typed, dated audit records (rows without a valid date are dropped)."""
    valid, _ = split_invalid(type_audit(raw))
    return valid


# ---------------------------------------------------------------- flights

def drop_undated(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    return df.na.drop(subset=[date_col])


def forward_fill(df: DataFrame, column: str, order_by: str,
                 partition_by: str, block_size: int = 1 << 20) -> DataFrame:
    """Fill nulls in ``column`` with the last non-null value before them in
    ``order_by`` order within ``partition_by`` (the source file; order has no
    meaning across files). Rows without a file count as one file.

    Scales past one huge file: rows are cut into blocks of ``block_size``
    consecutive order values; each block is filled by its own window, and the
    value carried into a block comes from a window over the small per-block
    summary. No task ever holds more than one block of one file.
    """
    keys = [partition_by]
    block = "_ff_block"
    staged = df.withColumn(block, F.floor(F.col(order_by) / F.lit(block_size)).cast("long"))

    last_in_block = (
        staged.groupBy(*keys, block)
        .agg(F.max(F.when(F.col(column).isNotNull(),
                          F.struct(F.col(order_by).alias("o"), F.col(column).alias("v"))))
             .getField("v").alias("_ff_last"))
    )
    carry_w = (Window.partitionBy(*keys).orderBy(block)
               .rowsBetween(Window.unboundedPreceding, -1))
    carries = last_in_block.select(
        F.col(partition_by).alias("_ff_file"), F.col(block).alias("_ff_in"),
        F.last("_ff_last", ignorenulls=True).over(carry_w).alias("_ff_carry"))

    inner_w = (Window.partitionBy(*keys, block).orderBy(order_by)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col(partition_by).eqNullSafe(F.col("_ff_file")) & (F.col(block) == F.col("_ff_in"))
    filled = (
        staged.join(carries, on=same, how="left")
        .withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(inner_w),
                                       F.col("_ff_carry")))
    )
    return filled.select(*df.columns)


def type_flights(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw flight records (exact headers) -> typed columns; undated kept."""
    texts, out = {}, []
    for src, dst in FLIGHT_HEADERS.items():
        c = F.col(dst)
        if dst == "flight_date":
            dated = isinstance(raw.schema[src].dataType, DATED)
            texts[dst] = F.to_date(src) if dated else br_text(src)
            out.append(c if dated else date_of_br_text(c).alias(dst))
        elif dst == "operator":
            texts[dst] = clean_operator(src)
            out.append(c)
        elif dst in ("routes", "flights"):
            texts[dst] = unicode_trim(F.col(src).cast("string"))
            out.append(number_of_text(c).alias(dst))
        else:
            texts[dst] = F.col(src).cast("string")
            out.append(c)
    texts |= {k: F.col(k) for k in keep}
    return parsed_once(_trimmed(raw, texts).select(*out, *keep))


def fill_dates(raw: DataFrame, order_by: str, file_col: str, block_size: int = 1 << 20) -> DataFrame:
    """Raw flight rows with the dates of merged cells filled in file order."""
    blanked = raw.withColumn("Data", blank_to_null("Data"))
    return forward_fill(blanked, "Data", order_by=order_by, partition_by=file_col, block_size=block_size)


def import_flights(raw: DataFrame, order_by: str, file_col: str,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Spreadsheet import: blank dates -> null -> forward fill in file order
    (merged cells), parse, drop still-undated rows, coerce, trim."""
    return drop_undated(type_flights(fill_dates(raw, order_by, file_col), keep=keep))


def clean_flights(raw: DataFrame) -> DataFrame:
    """Stored flight log (dates as dd/MM/yyyy text) -> typed, dated rows."""
    return drop_undated(type_flights(raw))


# ---------------------------------------------------------------- derived columns

def with_storage_dates(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """Dates as 'dd/MM/yyyy' text, the at-rest format of the flight log."""
    return df.withColumn(date_col, format_date_br(date_col))


def with_period(df: DataFrame, date_col: str = "audit_date") -> DataFrame:
    return (df.withColumn("year_month", F.date_format(date_col, "yyyy-MM"))
              .withColumn("year", F.date_format(date_col, "yyyy")))


def with_month_abbr(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """Upper-case month abbreviation with no year (JAN, FEB, ...)."""
    return df.withColumn("month_abbr", F.upper(F.date_format(date_col, "MMM")))


def with_weekday(df: DataFrame, date_col: str = "audit_date") -> DataFrame:
    """English weekday name and its Monday-first position (0 = Monday)."""
    return (df.withColumn("weekday", F.date_format(date_col, "EEEE"))
              .withColumn("weekday_idx", F.weekday(date_col)))


def with_retention(df: DataFrame) -> DataFrame:
    """Per-row grand total and retention rate (detail table)."""
    return (df.withColumn("row_total", F.col("released") + F.col("retained"))
              .withColumn("retained_pct", retention_rate("released", "retained")))


def with_labels(df: DataFrame, value_col: str, pct_col: str | None = None) -> DataFrame:
    out = df.withColumn(f"{value_col}_label", label_int(value_col))
    if pct_col:
        out = out.withColumn(f"{pct_col}_label", label_pct(pct_col))
    return out


def period_label(df: DataFrame, start, end, date_col: str = "audit_date") -> DataFrame:
    """One row: 'dd/MM/yyyy a dd/MM/yyyy' and the sorted year list, or
    'Sem dados' / '-' when the frame is empty."""
    s, e = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    years = F.array_join(F.sort_array(F.collect_set(F.year(date_col))), ", ")
    empty = F.count(F.lit(1)) == 0
    return df.agg(
        F.when(empty, F.lit("Sem dados")).otherwise(
            F.concat(F.date_format(s, "dd/MM/yyyy"), F.lit(" a "),
                     F.date_format(e, "dd/MM/yyyy"))).alias("period_label"),
        F.when(empty, F.lit("-")).otherwise(years).alias("years_label"),
    )


# ---------------------------------------------------------------- manual records

def _count(c: str) -> Column:
    """A whole number, zero or more."""
    return (F.col(c) >= 0) & (F.col(c) == F.floor(c))


def validate_audit(records: DataFrame, operations: Sequence[str] = OPERATIONS) -> DataFrame:
    """Form records: carrier required, operation one of the form's, counts
    whole and not negative, total = released + retained. Invalid rows are
    flagged, not dropped."""
    ok = ((unicode_trim("carrier") != "") & F.col("operation").isin(*operations)
          & _count("released") & _count("retained") & F.col("audit_date").isNotNull())
    return (records
            .withColumn("total", F.col("released") + F.col("retained"))
            .withColumn("is_valid", F.coalesce(ok, F.lit(False))))


def validate_flight(records: DataFrame) -> DataFrame:
    """Form records: operator required, type FIXO/RESERVA, counts whole and
    not negative."""
    ok = ((unicode_trim("operator") != "") & F.col("shift_type").isin(*SHIFT_TYPES)
          & _count("routes") & _count("flights") & F.col("flight_date").isNotNull())
    return records.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- reshaping

def unpivot_measures(df: DataFrame, ids: Sequence[str],
                     measures: Sequence[str] = ("routes", "flights")) -> DataFrame:
    """Wide -> long (one row per id and measure) for grouped bars."""
    return df.unpivot(list(ids), list(measures), "measure", "value")


__all__ = [
    "WEEKDAY_ORDER", "normalize_headers", "select_expected", "type_audit", "split_invalid",
    "clean_audit", "drop_undated", "forward_fill", "type_flights", "import_flights",
    "clean_flights", "fill_dates", "with_total", "with_storage_dates", "with_period", "with_month_abbr", "with_weekday",
    "with_retention", "with_labels", "period_label", "validate_audit", "validate_flight",
    "unpivot_measures", "AUDIT_COLUMNS", "FLIGHT_COLUMNS",
]
