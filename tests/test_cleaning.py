import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatewatch.operators import cleaning as C
from gatewatch.schemas import AUDIT_RAW, FLIGHT_RAW

# Invented audit upload rows (FIXTURES.md, schema A)
AUDIT_ROWS = [
    ("05/03/2025", "ALFA", "LML", "12", "3", None),
    (" 5/3/2025 ", "ALFA", "LML", "1.234", "1,5", None),
    ("45321", "BETA", "Direta", "7", "0", None),
    ("31/09/2025", "BETA", "Reversa", "4", "1", None),
    ("31/04/2025", "GAMA", "Outros", "9", "2", None),
    ("sem data", "GAMA", "LML", "x", None, None),
    ("2025-02-01", "ALFA", "LML", "1", "1", None),
    ("05/03/2025", None, "LML", "2", "2", None),
    ("06/03/2025", "DELTA", "Direta", "0", "0", None),
]


def audit_raw(spark):
    return spark.createDataFrame(AUDIT_ROWS, AUDIT_RAW)


def test_normalize_headers_p1(spark):
    df = spark.createDataFrame([(1, 2)], "` data ` int, `operação` int")
    assert C.normalize_headers(df).columns == ["DATA", "OPERAÇÃO"]


def test_select_expected_p10(spark):
    df = spark.createDataFrame([(1, 2, 3)], "DATA int, X int, MALHA int")
    assert C.select_expected(df, ["DATA", "MALHA", "LIBERADOS"]).columns == ["DATA", "MALHA"]


def test_clean_audit_and_rejects_p6(spark):
    typed = C.type_audit(audit_raw(spark))
    valid, summary = C.split_invalid(typed)
    assert valid.count() == 7
    s = summary.first()
    assert (s.rejected_rows, s.lost_volume) == (2, 11.0)
    got = {(r.audit_date, r.carrier, r.released, r.retained) for r in valid.collect()}
    assert (dt.date(2024, 1, 30), "BETA", 7.0, 0.0) in got
    assert (dt.date(2025, 3, 5), "ALFA", 1234.0, 1.5) in got
    assert (dt.date(2025, 9, 30), "BETA", 4.0, 1.0) in got
    assert (dt.date(2025, 2, 1), "ALFA", 1.0, 1.0) in got


def test_valid_plus_rejected_equals_input(spark):
    typed = C.type_audit(audit_raw(spark))
    valid, summary = C.split_invalid(typed)
    assert valid.count() + summary.first().rejected_rows == len(AUDIT_ROWS)


def test_typed_dates_pass_through(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 2), "A", "LML", 1.0, 2.0)],
                               "DATA date, TRANSPORTADORA string, `OPERAÇÃO` string, LIBERADOS double, MALHA double")
    r = C.type_audit(df).first()
    assert r.audit_date == dt.date(2025, 1, 2) and r.total == 3.0


def test_total_rule(spark):
    rows = [("05/03/2025", "A", "LML", "12", "3", t) for t in ("20", None, " ", "x")]
    assert [r.total for r in C.type_audit(spark.createDataFrame(rows, AUDIT_RAW)).collect()] == [20.0, 15.0, 15.0, 0.0]


def test_forward_fill_of_rows_without_a_file(spark):
    df = spark.createDataFrame([(None, i, "a" if i == 0 else None) for i in range(3)], "f string, n long, v string")
    for block in (1, 2, 8):
        assert [r.v for r in C.forward_fill(df, "v", "n", "f", block).orderBy("n").collect()] == ["a"] * 3


def _naive_ffill(df, col, order, part):
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def test_forward_fill_blocks_match_single_window_p9(spark):
    rows = []
    for f in range(3):
        for i in range(40):
            v = f"d{f}-{i}" if (i % 7 == 0 and i > 0) or (f == 1 and i == 0) else None
            rows.append((f, i, v))
    df = spark.createDataFrame(rows, "file_id int, row_no long, v string")
    expected = sorted(tuple(r) for r in _naive_ffill(df, "v", "row_no", "file_id").collect())
    for block in (1, 2, 5, 64):
        got = sorted(tuple(r) for r in C.forward_fill(df, "v", "row_no", "file_id", block_size=block).collect())
        assert got == expected, block


def test_import_flights_fixture_b(spark):
    nb = "\u00a0"
    raw = spark.createDataFrame([
        (0, "01/03/2025", "OP-1", "FIXO", "20.0", "8.0", None),
        (1, " ", "OP-1 ", "FIXO ", "10", "4", "chuva forte"),
        (2, "02/03/2025", None, "RESERVA", None, "0", "FALTA"),
        (3, "03/03/2025", "OP-2" + nb, "FIXO", "6", "3", "FOGOS"),
    ], "row_no long, Data string, Operador string, Tipo string, Rotas string, Voos string, Obs string")
    got = sorted(tuple(r) for r in C.import_flights(raw.withColumn("f", F.lit("one")), "row_no", "f").collect())
    assert got == [
        (dt.date(2025, 3, 1), "OP-1", "FIXO", 20.0, 8.0, None),
        (dt.date(2025, 3, 1), "OP-1", "FIXO ", 10.0, 4.0, "chuva forte"),
        (dt.date(2025, 3, 2), "Não Informado", "RESERVA", 0.0, 0.0, "FALTA"),
        (dt.date(2025, 3, 3), "OP-2", "FIXO", 6.0, 3.0, "FOGOS"),
    ]


def test_clean_flights_drops_undated_p7(spark):
    raw = spark.createDataFrame([("bad", "A", "FIXO", "1", "1", None), ("02/01/2025", "A", "FIXO", "1", "1", None)],
                                FLIGHT_RAW)
    assert C.clean_flights(raw).count() == 1


def test_derived_columns_p11_to_p14(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 3),)], "audit_date date")
    r = C.with_weekday(C.with_period(df)).first()
    assert (r.year_month, r.year, r.weekday, r.weekday_idx) == ("2025-03", "2025", "Monday", 0)
    f = spark.createDataFrame([(dt.date(2025, 3, 3),)], "flight_date date")
    assert C.with_month_abbr(f).first().month_abbr == "MAR"
    assert C.with_storage_dates(f).first().flight_date == "03/03/2025"


def test_period_label_p18(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 3),), (dt.date(2024, 1, 1),)], "audit_date date")
    r = C.period_label(df, "2024-01-01", "2025-03-31").first()
    assert (r.period_label, r.years_label) == ("01/01/2024 a 31/03/2025", "2024, 2025")
    e = C.period_label(df.where("false"), "2024-01-01", "2025-03-31").first()
    assert (e.period_label, e.years_label) == ("Sem dados", "-")


def test_validate_records_p19_p20(spark):
    a = spark.createDataFrame([(dt.date(2025, 1, 1), "A", "LML", 2.0, 1.0), (dt.date(2025, 1, 1), "", "LML", 2.0, 1.0),
                               (dt.date(2025, 1, 1), "B", "LML", -1.0, 1.0), (dt.date(2025, 1, 1), "B", "NOPE", 1.0, 1.0),
                               (dt.date(2025, 1, 1), "B", "LML", 1.5, 1.0), (dt.date(2025, 1, 1), "\u00a0", "LML", 1.0, 1.0),
                               (dt.date(2025, 1, 1), None, "LML", 1.0, 1.0)],
                              "audit_date date, carrier string, operation string, released double, retained double")
    assert [(r.total, r.is_valid) for r in C.validate_audit(a).collect()] == [
        (3.0, True), (3.0, False), (0.0, False), (2.0, False), (2.5, False), (2.0, False), (2.0, False)]
    f = spark.createDataFrame([(dt.date(2025, 1, 1), "OP", "FIXO", 1.0, 1.0), (dt.date(2025, 1, 1), "OP", "EXTRA", 1.0, 1.0)],
                              "flight_date date, operator string, shift_type string, routes double, flights double")
    assert [r.is_valid for r in C.validate_flight(f).collect()] == [True, False]


def test_unpivot_p22(spark):
    df = spark.createDataFrame([("OP", 3.0, 1.0)], "operator string, routes double, flights double")
    got = sorted(tuple(r) for r in C.unpivot_measures(df, ["operator"]).collect())
    assert got == [("OP", "flights", 1.0), ("OP", "routes", 3.0)]
