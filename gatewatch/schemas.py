"""Fixed schemas of the two modules: exit-gate audit and flight log.

Raw schemas read every field as text; cleaning turns them into the typed
schemas with explicit expressions (no schema inference).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Source headers as they appear in the operators' files,
# mapped to the build's ASCII column names.
AUDIT_HEADERS = {
    "DATA": "audit_date",
    "TRANSPORTADORA": "carrier",
    "OPERAÇÃO": "operation",
    "LIBERADOS": "released",
    "MALHA": "retained",
    "TOTAL TRANSPORTADORAS": "total",
}
FLIGHT_HEADERS = {
    "Data": "flight_date",
    "Operador": "operator",
    "Tipo": "shift_type",
    "Rotas": "routes",
    "Voos": "flights",
    "Obs": "notes",
}

# Form domains and defaults.
OPERATIONS = ["LML", "Direta", "Reversa", "Outros"]
SHIFT_TYPES = ["FIXO", "RESERVA"]
UNKNOWN_OPERATOR = "Não Informado"

AUDIT_COLUMNS = ["audit_date", "carrier", "operation", "released", "retained", "total"]
FLIGHT_COLUMNS = ["flight_date", "operator", "shift_type", "routes", "flights", "notes"]

AUDIT_RAW = T.StructType([T.StructField(c, T.StringType(), True) for c in AUDIT_HEADERS])
FLIGHT_RAW = T.StructType([T.StructField(c, T.StringType(), True) for c in FLIGHT_HEADERS])

AUDIT = T.StructType([
    T.StructField("audit_date", T.DateType(), False),
    T.StructField("carrier", T.StringType(), True),
    T.StructField("operation", T.StringType(), True),
    T.StructField("released", T.DoubleType(), False),
    T.StructField("retained", T.DoubleType(), False),
    T.StructField("total", T.DoubleType(), True),
])

FLIGHTS = T.StructType([
    T.StructField("flight_date", T.DateType(), False),
    T.StructField("operator", T.StringType(), False),
    T.StructField("shift_type", T.StringType(), True),
    T.StructField("routes", T.DoubleType(), False),
    T.StructField("flights", T.DoubleType(), False),
    T.StructField("notes", T.StringType(), True),
])
