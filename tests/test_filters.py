import datetime as dt

from gatewatch.operators import filters as FL

D = dt.date


def audit(spark):
    rows = [(D(2024, 12, 30), "A", "LML", 1, 1), (D(2025, 1, 2), "A", "Direta", 2, 0),
            (D(2025, 1, 6), "B", "LML", 3, 1), (D(2025, 1, 8), None, "LML", 4, 0),
            (D(2025, 1, 8), "B", None, 5, 5), (D(2025, 2, 1), "C", "Reversa", 6, 0)]
    return spark.createDataFrame(rows, "audit_date date, carrier string, operation string, released long, retained long")


def dates(df, col="audit_date"):
    return sorted(r[0] for r in df.select(col).collect())


def test_none_means_all_and_empty_means_nothing_t8(spark):
    df = audit(spark)
    assert FL.filter_audit(df).count() == 6
    assert FL.filter_audit(df, operations=[]).count() == 0
    assert FL.filter_audit(df, carriers=["A", "B"]).count() == 4


def test_filter_audit_f1(spark):
    got = FL.filter_audit(audit(spark), years=[2025], start="2025-01-02", end="2025-01-08", operations=["LML"])
    assert dates(got) == [D(2025, 1, 6), D(2025, 1, 8)]


def test_previous_period_f7_t11(spark):
    assert FL.previous_window("2025-01-06", "2025-01-08") == (D(2025, 1, 3), D(2025, 1, 5))
    got = FL.previous_period(audit(spark), "2025-01-03", "2025-01-08")
    assert dates(got) == [D(2024, 12, 30), D(2025, 1, 2)]


def test_last_data_days_f8(spark):
    assert dates(FL.last_data_days(audit(spark), 5)) == [D(2025, 2, 1)]
    small = audit(spark).where("audit_date < date'2025-01-03'")
    assert dates(FL.last_data_days(small, 5)) == [D(2024, 12, 30), D(2025, 1, 2)]


def test_current_week_f9_t13(spark):
    got = FL.current_week(audit(spark).where("audit_date <= date'2025-01-08'"))
    assert dates(got) == [D(2025, 1, 6), D(2025, 1, 8), D(2025, 1, 8)]


def test_single_day_f10(spark):
    assert dates(FL.single_day(audit(spark))) == [D(2025, 2, 1)]
    assert dates(FL.single_day(audit(spark), operations=["LML"])) == [D(2025, 1, 8)]
    assert dates(FL.single_day(audit(spark), day="2025-01-02")) == [D(2025, 1, 2)]


def test_last_months_f11(spark):
    from gatewatch.operators.cleaning import with_period
    df = with_period(audit(spark))
    assert dates(FL.last_months(df, 2), "year_month") == ["2025-01"] * 4 + ["2025-02"]
    assert FL.last_months(df, 3, months=[]).count() == 6
    assert FL.last_months(df, 3, months=["2024-12"]).count() == 1


def flights(spark):
    rows = [(D(2025, 3, 1), "OP-1"), (D(2025, 3, 8), "OP-2"), (D(2025, 6, 1), "OP-1"), (D(2026, 3, 2), "OP-1")]
    return spark.createDataFrame(rows, "flight_date date, operator string")


def test_flight_filters_f2_to_f6_f14(spark):
    df = flights(spark)
    assert FL.filter_operators(df, []).count() == 0
    assert FL.filter_operators(df, ["OP-2"]).count() == 1
    assert FL.filter_dates(df, "2025-03-01").count() == 1
    assert FL.filter_dates(df, "2025-03-01", "2025-03-08").count() == 2
    assert dates(FL.last_days(df, "2025-03-08", 7), "flight_date") == [D(2025, 3, 1), D(2025, 3, 8)]
    assert FL.filter_year(df, 2026).count() == 1 and FL.filter_year(df).count() == 4
    assert FL.month_of(df, "2030-03-15").count() == 3


def test_timeline_f12(spark):
    df = flights(spark)
    assert dates(FL.timeline(df, "2026-04-01", 90), "flight_date") == [D(2026, 3, 2)]
    assert FL.timeline(df, "2030-01-01", 90).count() == 4
    one = df.where("flight_date = date'2025-03-01'")
    assert FL.timeline(one, "2025-03-01", 90).count() == 1


def test_distinct_lists_d1_to_d5(spark):
    df = audit(spark)
    assert [r.year for r in FL.years(df).collect()] == [2025, 2024]
    assert [r.carrier for r in FL.values(df, "carrier").collect()] == [None, "A", "B", "C"]
    b = FL.date_bounds(df, "2030-01-01").first()
    assert (b.min_date, b.max_date) == (D(2024, 12, 30), D(2025, 2, 1))
    e = FL.date_bounds(df.where("false"), "2030-01-01").first()
    assert (e.min_date, e.max_date) == (D(2030, 1, 1), D(2030, 1, 1))
