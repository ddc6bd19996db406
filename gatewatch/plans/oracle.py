"""DuckDB twins of the adapter views and column expressions.

Used only to build the oracle SQL strings checked against the Spark
queries; nothing here runs inside a Spark job.
"""

from __future__ import annotations

from ..functions.dates import DAY_FIRST, PIVOT

# ---------------------------------------------------------------- expression templates

_WS = "(" + " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace()) + ")"
_DECIMAL = r"'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
_THOUSANDS = r"'^[+-]?[0-9]{1,3}([.][0-9]{3})+$'"
_DAY_FIRST = f"'{DAY_FIRST}'"
_ISO = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$'"
_SERIAL = r"'^[0-9]+([.][0-9]+)?$'"


def trim(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {_WS})"


def number_or_zero(x: str) -> str:
    t = trim(x)
    return (f"COALESCE(CASE WHEN regexp_matches({t}, {_DECIMAL}) "
            f"THEN TRY_CAST({t} AS DOUBLE) END, 0.0)")


def number_br(x: str) -> str:
    t = trim(x)
    n = (f"(CASE WHEN contains({t}, ',') OR regexp_matches({t}, {_THOUSANDS}) "
         f"THEN replace(replace({t}, '.', ''), ',', '.') ELSE {t} END)")
    return f"COALESCE(CASE WHEN regexp_matches({n}, {_DECIMAL}) THEN TRY_CAST({n} AS DOUBLE) END, 0.0)"


def _day_first(t: str) -> str:
    part = lambda k: f"regexp_extract({t}, {_DAY_FIRST}, {k})"
    y = part(3)
    year = f"(CASE WHEN length({y}) = 4 THEN {y} WHEN {y} >= '{PIVOT}' THEN '19' || {y} ELSE '20' || {y} END)"
    day = f"{year} || '-' || {part(2)} || '-' || {part(1)}"
    return (f"CASE WHEN regexp_matches({t}, {_DAY_FIRST}) "
            f"THEN CAST(try_strptime({day}, '%Y-%m-%d') AS DATE) END")


def _iso(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, {_ISO}) "
            f"THEN CAST(try_strptime(substr({t}, 1, 10), '%Y-%m-%d') AS DATE) END")


def date_br(x: str) -> str:
    t = trim(x)
    return f"COALESCE({_day_first(t)}, {_iso(t)})"


def date_robust(x: str) -> str:
    t = f"replace({trim(x)}, '31/09', '30/09')"
    num = f"TRY_CAST({t} AS DOUBLE)"
    return (
        "COALESCE("
        f"{_day_first(t)}, {_iso(t)}, "
        f"CASE WHEN regexp_matches({t}, {_SERIAL}) AND {num} <= 2958465 THEN "
        f"CAST(TIMESTAMP '1899-12-30 00:00:00' + to_seconds(CAST(round({num} * 86400) AS BIGINT)) AS DATE) END)"
    )


def ratio_half_up(num: str, den: str, scale: int, digits: int) -> str:
    factor = 10 ** digits
    return (
        f"(CASE WHEN {den} IS NULL OR {den} <= 0 THEN 0.0 "
        f"WHEN {num} = floor({num}) AND {den} = floor({den}) THEN "
        f"CAST((CAST({num} AS HUGEINT) * {2 * scale * factor} + CAST({den} AS HUGEINT)) "
        f"// (CAST({den} AS HUGEINT) * 2) AS DOUBLE) / {factor} "
        f"ELSE round({num} * {scale} / {den}, {digits}) END)"
    )


def rate(released: str, retained: str) -> str:
    return ratio_half_up(retained, f"({released} + {retained})", 100, 2)


def label_int(x: str) -> str:
    return f"replace(format('{{:,}}', CAST(round({x}) AS BIGINT)), ',', '.')"


def label_pct(x: str) -> str:
    return f"(replace(printf('%.2f', {x}), '.', ',') || '%')"


def label_dec1(x: str) -> str:
    return f"replace(printf('%.1f', {x}), '.', ',')"


def operator_clean(x: str) -> str:
    return trim(f"COALESCE(CAST({x} AS VARCHAR), 'Não Informado')")


# ---------------------------------------------------------------- adapter views

AUDIT = """audit AS (
  SELECT CAST(l.l_shipdate AS DATE) AS audit_date,
         CASE WHEN l.l_suppkey % 37 <> 5 THEN s.s_name END AS carrier,
         o.o_orderpriority AS operation,
         CAST(count(*) FILTER (WHERE l.l_returnflag <> 'R') AS BIGINT) AS released,
         CAST(count(*) FILTER (WHERE l.l_returnflag = 'R') AS BIGINT) AS retained,
         CAST(count(*) AS BIGINT) AS total
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3)"""

AUDIT_IDS = """audit_ids AS (
  SELECT *, concat_ws('|', CAST(audit_date AS VARCHAR), carrier, operation) AS row_id FROM audit)"""

_D = "CAST(l_shipdate AS DATE)"
_K = "((l_orderkey + l_linenumber) % 5)"
_Q = "(CAST(l_quantity AS BIGINT) * 100)"
_SERIAL_TXT = f"CAST({_D} - DATE '1899-12-30' AS VARCHAR)"

AUDIT_RAW = f"""audit_raw AS (
  SELECT l_orderkey AS src_order, l_linenumber AS src_line,
    CASE WHEN {_K} = 0 THEN CASE l_orderkey % 5 WHEN 0 THEN strftime({_D}, '%d/%m/%Y')
                WHEN 1 THEN strftime({_D}, '%d/%m/%Y 00:00:00') WHEN 2 THEN strftime({_D}, '%d-%m-%Y')
                WHEN 3 THEN strftime({_D}, '%d.%m.%Y 14:30') ELSE strftime({_D}, '%d/%m/%y') END
         WHEN {_K} = 1 THEN ' ' || CAST(day({_D}) AS VARCHAR) || '/' || CAST(month({_D}) AS VARCHAR)
                            || '/' || CAST(year({_D}) AS VARCHAR) || ' '
         WHEN {_K} = 2 THEN CASE WHEN l_linenumber % 2 = 1 THEN {_SERIAL_TXT} || '.75' ELSE {_SERIAL_TXT} END
         WHEN {_K} = 3 THEN '31/09/' || CAST(year({_D}) AS VARCHAR)
         WHEN l_linenumber % 2 = 1 THEN 'sem data'
         ELSE strftime({_D}, '%Y-%m-%d') END AS raw_date,
    'S' || CAST(l_suppkey AS VARCHAR) AS raw_carrier,
    CASE WHEN l_linestatus = 'F' THEN 'Direta' ELSE 'LML' END AS raw_operation,
    CASE WHEN l_orderkey % 3 = 0 THEN
           CASE WHEN {_Q} >= 1000 THEN CAST({_Q} // 1000 AS VARCHAR) || '.' || lpad(CAST({_Q} % 1000 AS VARCHAR), 3, '0')
                ELSE CAST({_Q} AS VARCHAR) END
         WHEN l_orderkey % 3 = 1 THEN replace(CAST(l_quantity AS VARCHAR), '.', ',')
         WHEN l_partkey % 7 = 0 THEN 'x'
         ELSE CAST({_Q} AS VARCHAR) END AS raw_released,
    CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS raw_retained
  FROM lineitem)"""

AUDIT_TYPED = f"""audit_typed AS (
  SELECT {date_robust('raw_date')} AS audit_date, raw_carrier AS carrier,
         raw_operation AS operation, {number_br('raw_released')} AS released,
         {number_br('raw_retained')} AS retained,
         {number_br('raw_released')} + {number_br('raw_retained')} AS total
  FROM audit_raw)"""

FLIGHTS = """flights AS (
  SELECT CAST(o_orderdate AS DATE) AS flight_date,
         CASE WHEN o_custkey % 41 <> 7 THEN 'OP-' || CAST(o_custkey AS VARCHAR) END AS operator,
         CASE WHEN o_custkey % 4 = 0 THEN 'RESERVA' ELSE 'FIXO' END AS shift_type,
         CAST(floor(o_totalprice / 1000) AS DOUBLE) AS routes,
         CAST(o_orderkey % 3 AS DOUBLE) AS flights,
         CAST(NULL AS VARCHAR) AS notes
  FROM orders)"""

FLIGHTS_RAW = """flights_raw AS (
  SELECT CASE WHEN user_id % 30 <> 7 THEN user_id END AS file_id, event_id AS row_no,
         CASE WHEN event_id % 5 = 0 THEN CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d/%m/%Y')
                WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%d-%m-%y')
                ELSE strftime(ts, '%d.%m.%Y') END
              WHEN event_id % 5 = 1 THEN '   ' END AS "Data",
         CASE WHEN event_id % 7 = 3 THEN NULL
              ELSE ' OP-' || CAST(user_id % 20 AS VARCHAR) || chr(160) END AS "Operador",
         CASE WHEN user_id % 4 = 0 THEN 'RESERVA' ELSE 'FIXO' END AS "Tipo",
         CASE WHEN event_id % 11 = 0 THEN 'n/d' ELSE printf('%.2f', value) END AS "Rotas",
         CAST(event_id % 4 AS VARCHAR) AS "Voos",
         event_type AS "Obs"
  FROM events)"""

# blank -> null, forward fill per file in row order, parse, drop undated
FLIGHTS_FILLED = f"""flights_filled AS (
  SELECT *, last_value(CASE WHEN {trim('"Data"')} = '' THEN NULL ELSE "Data" END IGNORE NULLS)
              OVER (PARTITION BY file_id ORDER BY row_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_date
  FROM flights_raw)"""

FLIGHTS_IMPORTED = f"""flights_imported AS (
  SELECT {date_br('filled_date')} AS flight_date, {operator_clean('"Operador"')} AS operator,
         "Tipo" AS shift_type, {number_or_zero('"Rotas"')} AS routes,
         {number_or_zero('"Voos"')} AS flights, "Obs" AS notes, file_id, row_no
  FROM flights_filled
  WHERE {date_br('filled_date')} IS NOT NULL)"""

NOTES = """notes AS (
  SELECT doc_id AS note_id, DATE '2025-01-01' + CAST(doc_id % 400 AS INTEGER) AS flight_date,
         CASE WHEN doc_id % 23 <> 0 THEN source END AS operator, 'FIXO' AS shift_type, CAST(0 AS DOUBLE) AS routes,
         CAST(0 AS DOUBLE) AS flights,
         CASE WHEN doc_id % 17 <> 0 THEN text || CASE doc_id % 11 WHEN 3 THEN ' Chuva forte' WHEN 4 THEN ' hélice quebrada'
                WHEN 5 THEN ' falta' WHEN 6 THEN ' fogos' ELSE '' END END AS notes
  FROM documents)"""

VIEWS = {
    "audit": [AUDIT],
    "audit_ids": [AUDIT, AUDIT_IDS],
    "audit_raw": [AUDIT_RAW],
    "audit_typed": [AUDIT_RAW, AUDIT_TYPED],
    "flights": [FLIGHTS],
    "flights_raw": [FLIGHTS_RAW],
    "flights_filled": [FLIGHTS_RAW, FLIGHTS_FILLED],
    "flights_imported": [FLIGHTS_RAW, FLIGHTS_FILLED, FLIGHTS_IMPORTED],
    "notes": [NOTES],
}


def with_views(select_sql: str, *views: str, extra: tuple[str, ...] = ()) -> str:
    """Prefix ``select_sql`` with the CTEs it needs (deduplicated, in order),
    followed by query-specific ``extra`` CTEs."""
    ctes: list[str] = []
    for v in views:
        for cte in VIEWS[v]:
            if cte not in ctes:
                ctes.append(cte)
    ctes.extend(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + select_sql
