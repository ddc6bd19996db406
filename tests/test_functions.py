import datetime as dt

from pyspark.sql import functions as F

from gatewatch.functions import (DEFAULT_RULES, category_of, clean_operator, label_decimal1,
                                 label_int, label_pct, parse_date_br, parse_date_robust,
                                 parse_number_br, ratio_1dp, retention_rate, to_number_or_zero,
                                 unicode_trim)
from gatewatch.functions.rates import axis_limit, rate_band


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_parse_number_br_t18(spark):
    vals = ["12", "1.234", "1,5", "1.234,5", "10.5", "x", None, "nan", "5d", " 7 ", "Infinity", "1.234.567"]
    got = one_col(spark, vals, parse_number_br)
    assert got == [12.0, 1234.0, 1.5, 1234.5, 10.5, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 1234567.0]


def test_to_number_or_zero_t2(spark):
    got = one_col(spark, ["3", "2.5", "", None, "abc", "1e2"], to_number_or_zero)
    assert got == [3.0, 2.5, 0.0, 0.0, 0.0, 100.0]


def test_parse_date_robust_fixture_a(spark):
    vals = ["05/03/2025", " 5/3/2025 ", "45321", "31/09/2025", "31/04/2025", "sem data",
            "2025-02-01", "2025-02-01 13:45:00", "45321.75", None, " 01/03/2025 "]
    got = one_col(spark, vals, parse_date_robust)
    assert got == [dt.date(2025, 3, 5), dt.date(2025, 3, 5), dt.date(2024, 1, 30), dt.date(2025, 9, 30),
                   None, None, dt.date(2025, 2, 1), dt.date(2025, 2, 1), dt.date(2024, 1, 30), None,
                   dt.date(2025, 3, 1)]


def test_parse_date_br_day_first_and_iso(spark):
    day = dt.date(2025, 3, 5)
    same = ["05/03/2025", "5/3/2025", "2025-03-05", "2025-03-05 00:00:00", "05/03/2025 00:00:00", "05/03/2025 14:30",
            "05-03-2025", "05.03.2025", "05/03/25"]
    for parse in (parse_date_br, parse_date_robust):
        assert one_col(spark, same, parse) == [day] * len(same)
        assert one_col(spark, ["05/03/68", "05/03/69"], parse) == [dt.date(2068, 3, 5), dt.date(1969, 3, 5)]
        assert one_col(spark, ["31/02/2025", "", "5/3", "05/03/2025 x", "5/3/202"], parse) == [None] * 5
    assert one_col(spark, ["45321"], parse_date_br) == [None]


def test_retention_rate_of_very_large_counts(spark):
    # halves are rounded up whatever the size; doubles would lose them
    rows = [(19999 * k, k) for k in (10**8, 10**11, 10**12 + 1, 10**13 + 3)] + [(5 * 10**16, 5 * 10**16)]
    df = spark.createDataFrame(rows, "released long, retained long")
    assert [r[0] for r in df.select(retention_rate("released", "retained")).collect()] == [0.01] * 4 + [50.0]


def test_unicode_trim_t16_and_operator_t17(spark):
    assert one_col(spark, ["OP-2 ", " OP-1 ", "\tX\n"], unicode_trim) == ["OP-2", "OP-1", "X"]
    assert one_col(spark, [None, " OP-1 "], clean_operator) == ["Não Informado", "OP-1"]


def test_retention_rate_t9_integer_half_up(spark):
    df = spark.createDataFrame([(7, 1), (2, 1), (1, 2), (0, 0), (3, 0), (199, 1), (1999, 1)],
                               "released long, retained long")
    got = [r[0] for r in df.select(retention_rate("released", "retained")).collect()]
    # 1/8 = 12.5; 1/3 = 33.33; 2/3 = 66.67; empty -> 0; 0.5 exactly; 0.05 exactly
    assert got == [12.5, 33.33, 66.67, 0.0, 0.0, 0.5, 0.05]


def test_ratio_1dp_and_labels(spark):
    df = spark.createDataFrame([(3.0, 2.0, 1234567.0, 12.5)], "r double, f double, big double, p double")
    r = df.select(ratio_1dp("r", "f"), label_int("big"), label_pct("p"), label_decimal1(F.lit(1.5))).first()
    assert tuple(r) == (1.5, "1.234.567", "12,50%", "1,5")


def test_rate_band_and_axis(spark):
    df = spark.createDataFrame([(4.99,), (5.0,), (10.0,), (30.0,)], "r double")
    got = [tuple(x) for x in df.select(rate_band("r"), axis_limit("r")).collect()]
    assert got == [("green", 20.0), ("yellow", 20.0), ("red", 20.0), ("red", 36.0)]


def test_classify_first_rule_wins_t14_t15(spark):
    notes = ["chuva forte", "CHUVA e ZOOM ruim", "linha 1\nHÉLICE quebrada", "FOGOS", "sem alteração",
             None, "happy app"]
    got = one_col(spark, notes, lambda c: category_of(c, DEFAULT_RULES))
    names = [c for c, _ in DEFAULT_RULES]
    assert got == [names[0], names[0], names[1], names[3], None, None, names[1]]
