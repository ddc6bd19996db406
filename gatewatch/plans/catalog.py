"""Registered queries: each inventory operator exercised over the adapter
views, with its DuckDB oracle SQL next to it.

Parameters (periods, as-of dates, rule lists) are fixed literals, as the
dashboard's widget values would be. Aggregating queries use the default
"everything" filter, so they read the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank_to_null, format_date_br, parse_date_br, report_line
from ..functions.classify import DEFAULT_RULES, rules_sql_case
from ..operators import cleaning as C
from ..operators import filters as FL
from ..operators import metrics as M
from ..operators import ordering as O
from ..operators import tables as TB
from ..session import scratch_path
from . import adapters as AD
from . import io_queries as IO
from . import oracle as Q
from .oracle import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A registered query: its name, the inventory IDs it exercises, the
    Spark builder and the DuckDB oracle SQL."""
    name: str
    covers: tuple[str, ...]
    build: Builder
    sql: str | None = None


# ---------------------------------------------------------------- fixed parameters

YEARS = [1996, 1997, 1998, 1999, 2000]
START, END = "1996-03-01", "2000-06-30"
OPERATIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
CARRIERS = [f"Supplier#{k:09d}" for k in range(1, 60, 2)]
OPERATORS = [f"OP-{k}" for k in range(1, 120)]
FLIGHT_AS_OF = "2001-06-15"
NOTES_AS_OF = "2025-12-31"
PROD_YEAR = 1998
RANGE_START, RANGE_END = "1997-01-01", "1997-12-31"

# Rules for the generated prose of the ``documents`` table (the default
# rules target drone-log remarks and rarely fire on it).
DOC_RULES = (
    ("license", ("LICENSE", "COPYRIGHT")),
    ("secret", ("TOKEN", "PASSWORD", "SECRET")),
    ("data", ("DATA",)),
    ("contact", ("@",)),
)


def _sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _sql_years(col: str, years) -> str:
    return "(" + " OR ".join(
        f"({col} >= DATE '{y}-01-01' AND {col} < DATE '{y + 1}-01-01')" for y in sorted(years)) + ")"


F1_SQL = (f"{_sql_years('audit_date', YEARS)} AND audit_date >= DATE '{START}' "
          f"AND audit_date <= DATE '{END}' AND operation IN ({_sql_list(OPERATIONS)})")
_PS, _PE = FL.previous_window(START, END)
PREV_SQL = (f"audit_date >= DATE '{_PS}' AND audit_date <= DATE '{_PE}' "
            f"AND operation IN ({_sql_list(OPERATIONS)})")


def _kpi_sql(src: str, where: str = "TRUE", prefix: str = "") -> str:
    return f"""
  SELECT r AS {prefix}released, m AS {prefix}retained,
         CASE WHEN t > 0 THEN t ELSE r + m END AS {prefix}total,
         {Q.ratio_half_up('m', '(CASE WHEN t > 0 THEN t ELSE r + m END)', 100, 2)} AS {prefix}retention_rate
  FROM (SELECT CAST(COALESCE(sum(released), 0) AS BIGINT) AS r,
               CAST(COALESCE(sum(retained), 0) AS BIGINT) AS m,
               CAST(sum(total) AS BIGINT) AS t
        FROM {src} WHERE {where})"""


def _rate_by_sql(key_expr: str, key: str, src: str = "audit", where: str = "TRUE") -> str:
    return f"""
SELECT {key}, carrier, released, retained, {Q.rate('released', 'retained')} AS retained_pct,
       {Q.label_int('released')} AS released_label,
       {Q.label_pct(Q.rate('released', 'retained'))} AS retained_pct_label
FROM (SELECT {key_expr} AS {key}, carrier, CAST(sum(released) AS BIGINT) AS released,
             CAST(sum(retained) AS BIGINT) AS retained
      FROM {src} WHERE {where} AND {key_expr} IS NOT NULL AND carrier IS NOT NULL
      GROUP BY 1, 2)"""


# ---------------------------------------------------------------- audit queries

def _audit(spark, sf):
    return AD.audit(spark, sf)


def _q_monthly(spark, sf):
    return M.rate_by(_audit(spark, sf), "year_month")


def _q_filter(spark, sf):
    return FL.filter_audit(_audit(spark, sf), YEARS, START, END, OPERATIONS)


def _q_kpis(spark, sf):
    return M.audit_kpis(_audit(spark, sf))


def _q_prev_kpis(spark, sf):
    return M.audit_kpis(FL.previous_period(_audit(spark, sf), START, END, OPERATIONS))


def _q_deltas(spark, sf):
    return M.kpi_deltas(_audit(spark, sf), YEARS, START, END, OPERATIONS)


_DELTAS_SQL = with_views(f"""
SELECT c.*, p.*, c.total - p.prev_total AS delta_total,
       c.released - p.prev_released AS delta_released,
       c.retained - p.prev_retained AS delta_retained,
       CASE WHEN c.retention_rate < 5 THEN 'green' WHEN c.retention_rate < 10 THEN 'yellow'
            ELSE 'red' END AS rate_band,
       greatest(CAST(20 AS DOUBLE), c.retention_rate * CAST(1.2 AS DOUBLE)) AS axis_limit
FROM ({_kpi_sql('audit', F1_SQL)}) c, ({_kpi_sql('audit', PREV_SQL, 'prev_')}) p""", "audit")


def _q_rank_released(spark, sf):
    return M.rank_released(_audit(spark, sf))


def _q_rank_retained(spark, sf):
    return M.rank_retained(_audit(spark, sf))


def _rank_sql(col: str) -> str:
    return with_views(f"""
SELECT carrier, {col}, {Q.label_int(col)} AS {col}_label
FROM (SELECT carrier, CAST(sum({col}) AS BIGINT) AS {col} FROM audit
      WHERE carrier IS NOT NULL GROUP BY carrier)""", "audit")


def _q_funnel(spark, sf):
    return M.funnel(_audit(spark, sf))


_FUNNEL_SQL = with_views(f"""
SELECT stage_order, stage, number, {Q.label_int('number')} AS number_label FROM (
  SELECT 0 AS stage_order, '{M.FUNNEL_STAGES[0]}' AS stage, total AS number FROM k
  UNION ALL SELECT 1, '{M.FUNNEL_STAGES[1]}', released FROM k
  UNION ALL SELECT 2, '{M.FUNNEL_STAGES[2]}', retained FROM k)""",
    "audit", extra=(f"k AS ({_kpi_sql('audit')})",))


def _q_heat(spark, sf):
    return M.heat_weekday(_audit(spark, sf))


_HEAT_SQL = with_views(f"""
SELECT weekday, weekday_idx, carrier, released, retained, {Q.rate('released', 'retained')} AS retained_pct
FROM (SELECT dayname(audit_date) AS weekday, CAST(isodow(audit_date) - 1 AS INTEGER) AS weekday_idx,
             carrier, CAST(sum(released) AS BIGINT) AS released, CAST(sum(retained) AS BIGINT) AS retained
      FROM audit WHERE carrier IS NOT NULL GROUP BY 1, 2, 3)""", "audit")


def _q_rate_by_day(spark, sf):
    return M.rate_by(_audit(spark, sf), "audit_date")


def _q_rate_by_year(spark, sf):
    return M.rate_by(_audit(spark, sf), "year")


def _q_volume_last_days(spark, sf):
    return M.volume_by_day(FL.last_data_days(_audit(spark, sf), 5))


_VOLUME_LAST_SQL = with_views(f"""
SELECT audit_date, carrier, operation, released, {Q.label_int('released')} AS released_label
FROM audit
WHERE audit_date >= (SELECT greatest(max(audit_date) - 4, min(audit_date)) FROM audit)""", "audit")


def _q_current_week(spark, sf):
    return M.rate_by(FL.current_week(_audit(spark, sf)), "audit_date")


def _q_single_day(spark, sf):
    return M.rate_by(FL.single_day(_audit(spark, sf), None, OPERATIONS), "audit_date")


def _q_last_months(spark, sf):
    return M.rate_by(FL.last_months(C.with_period(_audit(spark, sf)), 3), "year_month")


def _q_share(key):
    def build(spark, sf):
        return M.share(_audit(spark, sf), key)
    return build


def _share_sql(key: str) -> str:
    return with_views(f"""
SELECT {key}, released, {Q.ratio_half_up('released', '(sum(released) OVER ())', 100, 2)} AS share_pct
FROM (SELECT {key}, CAST(sum(released) AS BIGINT) AS released FROM audit
      WHERE {key} IS NOT NULL GROUP BY 1)""", "audit")


def _q_years(spark, sf):
    return FL.years(_audit(spark, sf))


def _q_values(col):
    def build(spark, sf):
        return FL.values(_audit(spark, sf), col)
    return build


def _q_dates(spark, sf):
    return FL.values(_audit(spark, sf), "audit_date")


def _q_months(spark, sf):
    return FL.values(C.with_period(_audit(spark, sf)), "year_month")


def _q_bounds(spark, sf):
    return FL.date_bounds(_audit(spark, sf), "2025-01-01")


def _q_detail(spark, sf):
    return O.detail(FL.filter_audit(_audit(spark, sf), YEARS, START, END, OPERATIONS))


def _q_period_label(spark, sf):
    return C.period_label(FL.filter_audit(_audit(spark, sf), YEARS, START, END, OPERATIONS), START, END)


def _fmt_br(d: str) -> str:
    y, m, dd = d.split("-")
    return f"{dd}/{m}/{y}"


_PERIOD_LABEL_SQL = with_views(f"""
SELECT CASE WHEN count(*) = 0 THEN 'Sem dados' ELSE '{_fmt_br(START)} a {_fmt_br(END)}' END AS period_label,
       CASE WHEN count(*) = 0 THEN '-' ELSE array_to_string(list_sort(list_distinct(list(year(audit_date)))), ', ')
       END AS years_label
FROM audit WHERE {F1_SQL}""", "audit")


def _q_sort_for_save(spark, sf):
    return O.sort_for_save(_audit(spark, sf))


def _q_edits(spark, sf):
    # some stored rows came without a total
    table = AD.audit_with_ids(spark, sf).withColumn(
        "total", F.when(F.dayofmonth("audit_date") % 3 != 0, F.col("total")))
    scope = FL.audit_predicate(years=[1998])
    edited = (table.where(scope).where(F.col("operation") != "5-LOW")
                   .withColumn("released", F.when(F.col("operation") == "1-URGENT",
                                                  F.col("released") + 1).otherwise(F.col("released"))))
    return TB.apply_edits(table, scope, edited)


_EDITS = f"""
SELECT audit_date, carrier, operation, released, retained, total, row_id
FROM audit_ids WHERE NOT {_sql_years('audit_date', [1998])}
UNION ALL
SELECT audit_date, carrier, operation, r, retained, r + retained, row_id
FROM (SELECT *, CASE WHEN operation = '1-URGENT' THEN released + 1 ELSE released END AS r
      FROM audit_ids WHERE {_sql_years('audit_date', [1998])} AND operation <> '5-LOW')"""
_EDITS_SQL = with_views(_EDITS, "audit_ids")


def _q_kpis_after_edit(spark, sf):
    return M.audit_kpis(_q_edits(spark, sf))


def _q_filter_carriers(spark, sf):
    return FL.filter_audit(_audit(spark, sf), YEARS, None, None, OPERATIONS, CARRIERS)


# ---------------------------------------------------------------- raw audit (cleaning)

def _q_clean_audit(spark, sf):
    return TB.replace_import(C.clean_audit(AD.audit_raw(spark, sf)))


def _q_rejects(spark, sf):
    return C.split_invalid(C.type_audit(AD.audit_raw(spark, sf)))[1]


def _q_select_expected(spark, sf):
    raw = C.normalize_headers(AD.audit_raw(spark, sf))
    return C.select_expected(raw, list(C.AUDIT_HEADERS))


def _reimport(spark, sf):
    """The stored table after a first import, and an import of part of it."""
    path = scratch_path(spark, f"stored-audit-{uuid.uuid4().hex}")
    C.clean_audit(AD.audit_raw(spark, sf)).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, FL.filter_audit(stored, start="1998-01-01", end="1998-12-31")


def _q_merge_import(spark, sf):
    old, new = _reimport(spark, sf)
    return TB.merge_import(old, new)


def _q_merge_report(spark, sf):
    old, new = _reimport(spark, sf)
    return M.merge_report(old, new)


def _q_merge_range(spark, sf):
    old, new = _reimport(spark, sf)
    return TB.merge_import(old, new, "audit_date")


def _q_merge_report_range(spark, sf):
    old, new = _reimport(spark, sf)
    return M.merge_report(old, new, "audit_date")


# stored rows in the import's range and the import itself; the other stored rows
_RANGE_CTES = ("stored AS (SELECT * FROM audit_typed WHERE audit_date IS NOT NULL)",
               "span AS (SELECT min(audit_date) AS lo, max(audit_date) AS hi FROM again)",
               "met AS (SELECT stored.* FROM stored, span WHERE audit_date BETWEEN lo AND hi UNION ALL SELECT * FROM again)",
               "far AS (SELECT stored.* FROM stored, span WHERE NOT audit_date BETWEEN lo AND hi)")


_REIMPORT_CTE = "again AS (SELECT * FROM audit_typed WHERE audit_date IS NOT NULL " \
                "AND audit_date >= DATE '1998-01-01' AND audit_date <= DATE '1998-12-31')"


def _q_append(spark, sf):
    return TB.append(*_reimport(spark, sf))


# ---------------------------------------------------------------- flight queries

def _flights(spark, sf):
    return AD.flights(spark, sf)


def _prod_sql(keys_expr: list[tuple[str, str]], src: str = "flights", where: str = "TRUE") -> str:
    sel = ", ".join(f"{e} AS {n}" for n, e in keys_expr)
    notnull = " AND ".join(f"{e} IS NOT NULL" for _, e in keys_expr)
    groups = ", ".join(str(i + 1) for i in range(len(keys_expr)))
    return (f"SELECT {sel}, sum(routes) AS routes, sum(flights) AS flights FROM {src} "
            f"WHERE {where} AND {notnull} GROUP BY {groups}")


_MONTH_ABBR = "upper(strftime(flight_date, '%b'))"


def _q_prod_month(spark, sf):
    return M.production(_flights(spark, sf), ["month_abbr", "operator"])


def _q_flight_kpis(spark, sf):
    return M.flight_kpis(_flights(spark, sf))


def _q_daily(spark, sf):
    return M.daily_production(_flights(spark, sf), FLIGHT_AS_OF, 7)


def _q_last90(spark, sf):
    return M.production(FL.last_days(_flights(spark, sf), FLIGHT_AS_OF, 90), ["month_abbr", "operator"])


def _q_prod_year(spark, sf):
    return M.production(FL.filter_year(_flights(spark, sf), PROD_YEAR), ["operator"])


def _q_prod_all(spark, sf):
    return M.production(FL.filter_year(_flights(spark, sf), None), ["operator"])


def _q_top(spark, sf):
    return M.top_operators(_flights(spark, sf), 5)


def _q_goal(spark, sf):
    return M.goal_progress(_flights(spark, sf), FLIGHT_AS_OF)


def _q_projection(spark, sf):
    return M.month_projection(_flights(spark, sf), FLIGHT_AS_OF)


def _q_efficiency(spark, sf):
    return M.efficiency(_flights(spark, sf))


def _q_unpivot(spark, sf):
    return C.unpivot_measures(M.production(_flights(spark, sf), ["operator"]), ["operator"])


def _q_operators(spark, sf):
    return FL.values(_flights(spark, sf), "operator")


def _q_flight_range(spark, sf):
    return FL.filter_dates(_flights(spark, sf), RANGE_START, RANGE_END)


def _q_flight_day(spark, sf):
    return FL.filter_dates(_flights(spark, sf), RANGE_START)


def _q_flights_no_ops(spark, sf):
    """What an empty selection leaves, beside what there is."""
    f = _flights(spark, sf)
    left = FL.filter_operators(f, []).groupBy("shift_type").agg(F.count(F.lit(1)).alias("selected"))
    return f.groupBy("shift_type").agg(F.count(F.lit(1)).alias("stored")).join(left, "shift_type", "left").select(
        "shift_type", "stored", F.coalesce("selected", F.lit(0).cast("long")).alias("selected"))


def _q_flights_ops(spark, sf):
    return FL.filter_operators(_flights(spark, sf), OPERATORS)


def _q_storage(spark, sf):
    return C.with_storage_dates(_flights(spark, sf))


def _q_report_lines(spark, sf):
    f = _flights(spark, sf)
    return f.select(report_line("operator", "flights", "routes").alias("line"))


def _q_validate_flight(spark, sf):
    """Flight rows as form records, some of them wrong in one of the ways."""
    r = F.col("r")
    f = _flights(spark, sf).withColumn("r", F.col("routes"))
    return C.validate_flight(f.withColumns({
        "routes": F.when(r % 7 == 3, r + 0.5).otherwise(r),
        "flights": F.when(r % 17 == 6, F.lit(-1.0)).otherwise(F.col("flights")),
        "operator": F.when(r % 11 == 4, F.lit(AD.NBSP)).otherwise(F.col("operator")),
        "shift_type": F.when(r % 13 == 5, F.lit("EXTRA")).otherwise(F.col("shift_type"))}).drop("r"))


def _q_validate_audit(spark, sf):
    """Audit rows as form records, some of them wrong in one of the ways."""
    day = F.dayofmonth("audit_date")
    a = AD.audit(spark, sf).drop("total").withColumns({
        "released": F.when(day == 5, F.col("released") + 0.5).when(day == 9, F.lit(-1.0))
        .otherwise(F.col("released").cast("double")),
        "carrier": F.when(day == 7, F.lit(AD.NBSP)).otherwise(F.col("carrier"))})
    return C.validate_audit(a, OPERATIONS)


def _q_month_abbr(spark, sf):
    return C.with_month_abbr(_flights(spark, sf)).select("flight_date", "month_abbr").distinct()


# ---------------------------------------------------------------- raw flights (import)

def _flights_import(spark, sf):
    return C.import_flights(AD.flights_raw(spark, sf), order_by="row_no", file_col="file_id",
                            keep=["file_id", "row_no"])


def _q_import(spark, sf):
    return _flights_import(spark, sf)


def _q_ffill(block_size):
    def build(spark, sf):
        raw = AD.flights_raw(spark, sf).withColumn("Data", blank_to_null("Data"))
        return C.forward_fill(raw, "Data", order_by="row_no", partition_by="file_id", block_size=block_size) \
            .select("file_id", "row_no", "Data")
    return build


def _q_preview(spark, sf):
    """The upload as it is seen before anything is dropped."""
    filled = C.fill_dates(AD.flights_raw(spark, sf), "row_no", "file_id")
    return O.preview(filled.withColumn("Data", format_date_br(parse_date_br("Data"))), "row_no", 5)


def _q_merge_flights(spark, sf):
    imported = _flights_import(spark, sf).drop("file_id", "row_no")
    return TB.merge_import(imported, imported)


# ---------------------------------------------------------------- notes (text)

def _notes(spark, sf):
    return AD.notes(spark, sf)


def _q_classify(spark, sf):
    return M.with_category(FL.with_notes(_notes(spark, sf)), DEFAULT_RULES) \
        .select("note_id", "flight_date", "operator", "category")


def _q_classify_docs(spark, sf):
    return M.with_category(FL.with_notes(_notes(spark, sf)), DOC_RULES) \
        .select("note_id", "flight_date", "operator", "category")


def _q_count_cat(spark, sf):
    return M.count_categories(_notes(spark, sf), DEFAULT_RULES)


def _q_count_cat_docs(spark, sf):
    return M.count_categories(_notes(spark, sf), DOC_RULES)


def _q_occ_detail(spark, sf):
    return O.occurrence_detail(_notes(spark, sf), DOC_RULES).drop("notes")


def _q_timeline(spark, sf):
    return O.occurrence_detail(FL.timeline(_notes(spark, sf), NOTES_AS_OF, 90), DOC_RULES) \
        .select("flight_date", "operator", "category", F.length("notes").alias("note_chars"))


def _cat_sql(rules) -> str:
    return rules_sql_case("notes", rules)


_TIMELINE_BOUNDS = """(SELECT CASE WHEN cand >= lo AND cand <= hi THEN cand ELSE lo END FROM (
   SELECT DATE '{cand}' AS cand, max(flight_date) AS hi,
          CASE WHEN min(flight_date) >= max(flight_date) THEN max(flight_date) - 1
               ELSE min(flight_date) END AS lo FROM notes))"""


def _timeline_sql() -> str:
    import datetime as dt
    cand = dt.date.fromisoformat(NOTES_AS_OF) - dt.timedelta(days=90)
    bounds = _TIMELINE_BOUNDS.format(cand=cand)
    return with_views(f"""
SELECT flight_date, operator, category, CAST(length(notes) AS INTEGER) AS note_chars FROM (
  SELECT *, {_cat_sql(DOC_RULES)} AS category FROM notes
  WHERE notes IS NOT NULL AND flight_date >= {bounds}
    AND flight_date <= (SELECT max(flight_date) FROM notes))
WHERE category IS NOT NULL""", "notes")


# ---------------------------------------------------------------- registry

def _build() -> list[Query]:
    audit = lambda s: with_views(s, "audit")
    flights = lambda s: with_views(s, "flights")
    notes = lambda s: with_views(s, "notes")
    rate = Q.rate("released", "retained")
    qs = [
        Query("audit_monthly_rate", ("A10", "P12", "P16", "P17", "S3"), _q_monthly,
              with_views(_rate_by_sql("strftime(audit_date, '%Y-%m')", "year_month"), "audit")),
        Query("audit_filter", ("F1",), _q_filter,
              audit(f"SELECT * FROM audit WHERE {F1_SQL}")),
        Query("audit_kpis", ("A1",), _q_kpis, audit(_kpi_sql("audit"))),
        Query("audit_kpis_after_edit", ("A1", "U4"), _q_kpis_after_edit,
              with_views(_kpi_sql("edited"), "audit_ids", extra=(f"edited AS ({_EDITS})",))),
        Query("audit_filter_carriers", ("F1",), _q_filter_carriers, audit(
            f"SELECT * FROM audit WHERE {_sql_years('audit_date', YEARS)} AND operation IN ({_sql_list(OPERATIONS)}) "
            f"AND carrier IN ({_sql_list(CARRIERS)})")),
        Query("audit_previous_kpis", ("A2", "F7"), _q_prev_kpis, audit(_kpi_sql("audit", PREV_SQL))),
        Query("audit_kpi_deltas", ("A3", "P21"), _q_deltas, _DELTAS_SQL),
        Query("audit_rank_released", ("A4", "P16"), _q_rank_released, _rank_sql("released")),
        Query("audit_rank_retained", ("A5", "P16"), _q_rank_retained, _rank_sql("retained")),
        Query("audit_funnel", ("A6",), _q_funnel, _FUNNEL_SQL),
        Query("audit_heat_weekday", ("A7", "P14"), _q_heat, _HEAT_SQL),
        Query("audit_rate_by_day", ("A8",), _q_rate_by_day,
              audit(_rate_by_sql("audit_date", "audit_date"))),
        Query("audit_volume_last_days", ("A9", "F8"), _q_volume_last_days, _VOLUME_LAST_SQL),
        Query("audit_rate_by_year", ("A11", "P12"), _q_rate_by_year,
              audit(_rate_by_sql("strftime(audit_date, '%Y')", "year"))),
        Query("audit_share_operation", ("A12",), _q_share("operation"), _share_sql("operation")),
        Query("audit_share_carrier", ("A13",), _q_share("carrier"), _share_sql("carrier")),
        Query("audit_current_week", ("F9", "A8"), _q_current_week, audit(_rate_by_sql(
            "audit_date", "audit_date", where="audit_date >= (SELECT CAST(date_trunc('week', max(audit_date)) AS DATE) FROM audit)"))),
        Query("audit_single_day", ("F10", "A8"), _q_single_day, audit(_rate_by_sql(
            "audit_date", "audit_date",
            where=f"operation IN ({_sql_list(OPERATIONS)}) AND audit_date = (SELECT max(audit_date) FROM audit "
                  f"WHERE operation IN ({_sql_list(OPERATIONS)}))"))),
        Query("audit_last_months", ("F11", "A10"), _q_last_months, audit(_rate_by_sql(
            "strftime(audit_date, '%Y-%m')", "year_month",
            where="strftime(audit_date, '%Y-%m') IN (SELECT DISTINCT strftime(audit_date, '%Y-%m') AS ym FROM audit "
                  "ORDER BY ym DESC LIMIT 3)"))),
        Query("audit_years", ("D1",), _q_years,
              audit("SELECT DISTINCT CAST(year(audit_date) AS INTEGER) AS year FROM audit "
                    "WHERE audit_date IS NOT NULL")),
        Query("audit_operations", ("D2",), _q_values("operation"),
              audit("SELECT DISTINCT operation FROM audit")),
        Query("audit_carriers", ("D2",), _q_values("carrier"),
              audit("SELECT DISTINCT carrier FROM audit")),
        Query("audit_dates", ("D5",), _q_dates, audit("SELECT DISTINCT audit_date FROM audit")),
        Query("audit_months", ("D5", "P12"), _q_months,
              audit("SELECT DISTINCT strftime(audit_date, '%Y-%m') AS year_month FROM audit")),
        Query("audit_date_bounds", ("D4",), _q_bounds, audit(
            "SELECT COALESCE(min(audit_date), DATE '2025-01-01') AS min_date, "
            "COALESCE(max(audit_date), DATE '2025-01-01') AS max_date FROM audit")),
        Query("audit_detail", ("O1", "P15"), _q_detail, audit(f"""
SELECT *, released + retained AS row_total, {rate} AS retained_pct FROM audit WHERE {F1_SQL}""")),
        Query("audit_period_label", ("P18",), _q_period_label, _PERIOD_LABEL_SQL),
        Query("audit_sorted_for_save", ("O2",), _q_sort_for_save, audit("SELECT * FROM audit")),
        Query("audit_apply_edits", ("U4",), _q_edits, _EDITS_SQL),
        Query("audit_validate_records", ("P19",), _q_validate_audit, audit(f"""
SELECT audit_date, carrier, operation, released, retained, released + retained AS total,
       COALESCE({Q.trim('carrier')} <> '' AND operation IN ({_sql_list(OPERATIONS)}) AND released >= 0
                AND released = floor(released) AND retained >= 0 AND audit_date IS NOT NULL, FALSE) AS is_valid
FROM (SELECT audit_date, CASE WHEN day(audit_date) = 7 THEN chr(160) ELSE carrier END AS carrier, operation,
             CASE day(audit_date) WHEN 5 THEN released + 0.5 WHEN 9 THEN -1.0 ELSE released END::DOUBLE AS released,
             retained FROM audit)""")),
        # raw audit uploads
        Query("audit_clean", ("P1", "P2", "P4", "P10", "U2"), _q_clean_audit, with_views(
            "SELECT * FROM audit_typed WHERE audit_date IS NOT NULL", "audit_typed")),
        Query("audit_rejects", ("P6",), _q_rejects, with_views("""
SELECT CAST(count(*) FILTER (WHERE audit_date IS NULL) AS BIGINT) AS rejected_rows,
       COALESCE(sum(CASE WHEN audit_date IS NULL THEN released + retained END), 0.0) AS lost_volume
FROM audit_typed""", "audit_typed")),
        Query("audit_select_expected", ("P1", "P10"), _q_select_expected, with_views("""
SELECT raw_date AS "DATA", raw_carrier AS "TRANSPORTADORA", raw_operation AS "OPERAÇÃO",
       raw_released AS "LIBERADOS", raw_retained AS "MALHA" FROM audit_raw""", "audit_raw")),
        Query("audit_merge_import", ("U1",), _q_merge_import, with_views(
            "SELECT DISTINCT * FROM (SELECT * FROM audit_typed WHERE audit_date IS NOT NULL "
            "UNION ALL SELECT * FROM again)", "audit_typed", extra=(_REIMPORT_CTE,))),
        Query("audit_merge_report", ("A22", "U1"), _q_merge_report, with_views(
            f"SELECT CAST((SELECT count(*) FROM u) AS BIGINT) AS rows_before, "
            f"CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS BIGINT) AS rows_after, "
            f"CAST((SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS BIGINT) "
            f"AS duplicates_ignored", "audit_typed", extra=(
                _REIMPORT_CTE, "u AS (SELECT * FROM audit_typed WHERE audit_date IS NOT NULL "
                "UNION ALL SELECT * FROM again)"))),
        Query("audit_merge_range", ("U1",), _q_merge_range, with_views(
            "SELECT * FROM far UNION ALL SELECT DISTINCT * FROM met", "audit_typed",
            extra=(_REIMPORT_CTE, *_RANGE_CTES))),
        Query("audit_merge_report_range", ("A22", "U1"), _q_merge_report_range, with_views(
            "SELECT f + b AS rows_before, f + a AS rows_after, b - a AS duplicates_ignored FROM (SELECT "
            "(SELECT count(*) FROM far) AS f, (SELECT count(*) FROM met) AS b, "
            "(SELECT count(*) FROM (SELECT DISTINCT * FROM met)) AS a)", "audit_typed",
            extra=(_REIMPORT_CTE, *_RANGE_CTES))),
        Query("audit_append", ("U3",), _q_append, with_views(
            "SELECT * FROM audit_typed WHERE audit_date IS NOT NULL "
            "UNION ALL SELECT * FROM again", "audit_typed", extra=(_REIMPORT_CTE,))),
        # flights
        Query("flights_production_month", ("A14", "P13"), _q_prod_month,
              flights(_prod_sql([("month_abbr", _MONTH_ABBR), ("operator", "operator")]))),
        Query("flights_kpis", ("A15",), _q_flight_kpis, flights("""
SELECT CAST(COALESCE(sum(flights), 0) AS BIGINT) AS total_flights,
       CAST(COALESCE(sum(routes), 0) AS BIGINT) AS total_routes,
       CAST(count(DISTINCT operator) AS BIGINT) AS operators FROM flights""")),
        Query("flights_daily_production", ("A16", "F4"), _q_daily, flights(_prod_sql(
            [("operator", "operator")],
            where=f"flight_date BETWEEN DATE '{FLIGHT_AS_OF}' - 7 AND DATE '{FLIGHT_AS_OF}'"))),
        Query("flights_last_90_days", ("F5", "A14"), _q_last90, flights(_prod_sql(
            [("month_abbr", _MONTH_ABBR), ("operator", "operator")],
            where=f"flight_date BETWEEN DATE '{FLIGHT_AS_OF}' - 90 AND DATE '{FLIGHT_AS_OF}'"))),
        Query("flights_production_year", ("A17", "F6"), _q_prod_year, flights(_prod_sql(
            [("operator", "operator")], where=f"year(flight_date) = {PROD_YEAR}"))),
        Query("flights_production_all", ("A17",), _q_prod_all,
              flights(_prod_sql([("operator", "operator")]))),
        Query("flights_top_operators", ("W1",), _q_top, flights(f"""
SELECT operator, routes, flights, CAST(rank AS INTEGER) AS rank,
       CASE WHEN rank = 1 THEN '{M.MEDALS[0]}' WHEN rank = 2 THEN '{M.MEDALS[1]}' ELSE '{M.MEDALS[2]}' END AS medal
FROM (SELECT *, row_number() OVER (ORDER BY flights DESC, operator ASC) AS rank
      FROM ({_prod_sql([("operator", "operator")])}) p)
WHERE rank <= 5""")),
        Query("flights_goal_progress", ("A19", "F14"), _q_goal, flights(f"""
SELECT operator, flights, {M.DEFAULT_GOAL} AS goal,
       least(flights / CAST({M.DEFAULT_GOAL} AS DOUBLE), CAST(1 AS DOUBLE)) AS progress
FROM ({_prod_sql([("operator", "operator")], where=f"month(flight_date) = {int(FLIGHT_AS_OF[5:7])}")})""")),
        Query("flights_month_projection", ("A20", "F14"), _q_projection, flights(f"""
SELECT CAST(floor(COALESCE(sum(flights), CAST(0 AS DOUBLE)) / CAST({int(FLIGHT_AS_OF[8:10])} AS DOUBLE)
                  * CAST(30 AS DOUBLE)) AS BIGINT) AS projection
FROM flights WHERE month(flight_date) = {int(FLIGHT_AS_OF[5:7])}""")),
        Query("flights_efficiency", ("A21",), _q_efficiency, flights(f"""
SELECT operator, routes, flights, {Q.ratio_half_up('routes', 'flights', 1, 1)} AS routes_per_flight,
       {Q.label_dec1(Q.ratio_half_up('routes', 'flights', 1, 1))} AS routes_per_flight_label
FROM ({_prod_sql([("operator", "operator")])}) WHERE flights > 0""")),
        Query("flights_unpivot", ("P22",), _q_unpivot, flights(f"""
SELECT operator, measure, value FROM ({_prod_sql([("operator", "operator")])})
UNPIVOT (value FOR measure IN (routes, flights))""")),
        Query("flights_operators", ("D3",), _q_operators, flights("SELECT DISTINCT operator FROM flights")),
        Query("flights_date_range", ("F3",), _q_flight_range, flights(
            f"SELECT * FROM flights WHERE flight_date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'")),
        Query("flights_single_date", ("F3",), _q_flight_day, flights(
            f"SELECT * FROM flights WHERE flight_date = DATE '{RANGE_START}'")),
        Query("flights_no_operator_selected", ("F2",), _q_flights_no_ops, flights(
            "SELECT shift_type, count(*) AS stored, count(*) FILTER (WHERE FALSE) AS selected FROM flights GROUP BY 1")),
        Query("flights_operators_selected", ("F2",), _q_flights_ops, flights(
            f"SELECT * FROM flights WHERE operator IN ({_sql_list(OPERATORS)})")),
        Query("flights_storage_format", ("P11",), _q_storage, flights(
            "SELECT strftime(flight_date, '%d/%m/%Y') AS flight_date, operator, shift_type, routes, flights, notes "
            "FROM flights")),
        Query("flights_report_lines", ("K6",), _q_report_lines, flights(
            "SELECT COALESCE(operator, 'Não Informado') || ' - ' || CAST(flights AS VARCHAR) || ' voos - ' || CAST(routes AS VARCHAR) "
            "|| ' rotas' AS line FROM flights")),
        Query("flights_validate_records", ("P20",), _q_validate_flight, flights(f"""
SELECT *, COALESCE({Q.trim('operator')} <> '' AND shift_type IN ('FIXO', 'RESERVA') AND routes >= 0
                   AND routes = floor(routes) AND flights >= 0 AND flight_date IS NOT NULL, FALSE) AS is_valid
FROM (SELECT flight_date, notes, CASE WHEN routes % 7 = 3 THEN routes + 0.5 ELSE routes END AS routes,
             CASE WHEN routes % 17 = 6 THEN -1.0 ELSE flights END AS flights,
             CASE WHEN routes % 11 = 4 THEN chr(160) ELSE operator END AS operator,
             CASE WHEN routes % 13 = 5 THEN 'EXTRA' ELSE shift_type END AS shift_type FROM flights)""")),
        Query("flights_month_labels", ("P13",), _q_month_abbr, flights(
            f"SELECT DISTINCT flight_date, {_MONTH_ABBR} AS month_abbr FROM flights")),
        # spreadsheet import
        Query("flights_import", ("P3", "P5", "P7", "P8", "P9"), _q_import, with_views(
            "SELECT * FROM flights_imported", "flights_imported")),
        Query("flights_forward_fill", ("P9",), _q_ffill(1 << 20), with_views(
            'SELECT file_id, row_no, filled_date AS "Data" FROM flights_filled', "flights_filled")),
        Query("flights_forward_fill_blocks", ("P9",), _q_ffill(16), with_views(
            'SELECT file_id, row_no, filled_date AS "Data" FROM flights_filled', "flights_filled")),
        Query("flights_import_preview", ("O4",), _q_preview, with_views(f"""
SELECT file_id, row_no, strftime({Q.date_br('filled_date')}, '%d/%m/%Y') AS "Data", "Operador", "Tipo", "Rotas",
       "Voos", "Obs" FROM flights_filled ORDER BY row_no LIMIT 5""", "flights_filled")),
        Query("flights_merge_import", ("U1",), _q_merge_flights, with_views(
            "SELECT DISTINCT flight_date, operator, shift_type, routes, flights, notes FROM flights_imported",
            "flights_imported")),
        # notes
        Query("notes_classify_default", ("P23", "F13"), _q_classify, notes(f"""
SELECT note_id, flight_date, operator, {_cat_sql(DEFAULT_RULES)} AS category FROM notes
WHERE notes IS NOT NULL""")),
        Query("notes_classify_rules", ("P23", "F13"), _q_classify_docs, notes(f"""
SELECT note_id, flight_date, operator, {_cat_sql(DOC_RULES)} AS category FROM notes
WHERE notes IS NOT NULL""")),
        Query("notes_count_default", ("A18",), _q_count_cat, notes(f"""
SELECT category, CAST(count(*) AS BIGINT) AS occurrences FROM (
  SELECT {_cat_sql(DEFAULT_RULES)} AS category FROM notes WHERE notes IS NOT NULL)
WHERE category IS NOT NULL GROUP BY category""")),
        Query("notes_count_rules", ("A18",), _q_count_cat_docs, notes(f"""
SELECT category, CAST(count(*) AS BIGINT) AS occurrences FROM (
  SELECT {_cat_sql(DOC_RULES)} AS category FROM notes WHERE notes IS NOT NULL)
WHERE category IS NOT NULL GROUP BY category""")),
        Query("notes_occurrence_detail", ("O3",), _q_occ_detail, notes(f"""
SELECT flight_date, operator, category FROM (
  SELECT *, {_cat_sql(DOC_RULES)} AS category FROM notes WHERE notes IS NOT NULL)
WHERE category IS NOT NULL""")),
        Query("notes_timeline_occurrences", ("F12", "O3"), _q_timeline, _timeline_sql()),
    ]
    return qs + [Query(name, covers, build, sql) for name, covers, build, sql in IO.QUERIES]


QUERIES: list[Query] = _build()
BY_NAME: dict[str, Query] = {q.name: q for q in QUERIES}
FLAGSHIP = "audit_monthly_rate"
