import datetime as dt

from pyspark.sql import functions as F

from gatewatch.operators import metrics as M
from gatewatch.operators import ordering as O
from gatewatch.operators.cleaning import with_period

D = dt.date


def audit(spark, with_total=True):
    rows = [(D(2025, 1, 6), "A", "LML", 10, 2, 12), (D(2025, 1, 7), "A", "Direta", 5, 1, 6),
            (D(2025, 1, 7), "B", "LML", 7, 0, 7), (D(2025, 2, 3), None, "LML", 3, 3, 6),
            (D(2024, 1, 8), "B", "LML", 1, 1, 2)]
    df = spark.createDataFrame(rows, "audit_date date, carrier string, operation string, released long, retained long, total long")
    return df if with_total else df.withColumn("total", F.lit(None).cast("long"))


def test_audit_kpis_t10(spark):
    k = M.audit_kpis(audit(spark)).first()
    assert (k.released, k.retained, k.total, k.retention_rate) == (26, 7, 33, 21.21)
    k2 = M.audit_kpis(audit(spark, with_total=False)).first()
    assert k2.total == 33


def test_kpi_deltas_a3(spark):
    k = M.kpi_deltas(audit(spark), years=[2025], start="2025-01-06", end="2025-01-07").first()
    assert (k.released, k.prev_released, k.delta_released) == (22, 0, 22)
    k = M.kpi_deltas(audit(spark), start="2025-01-07", end="2025-01-07").first()
    assert (k.total, k.prev_total, k.delta_total, k.rate_band) == (13, 12, 1, "yellow")


def test_rankings_and_rates_drop_null_keys_t7(spark):
    df = audit(spark)
    assert [tuple(r) for r in M.rank_released(df).collect()] == [("B", 8, "8"), ("A", 15, "15")]
    assert [r.carrier for r in M.rank_retained(df).collect()] == ["B", "A"]
    got = {(r.year_month, r.carrier): r.retained_pct for r in M.rate_by(df, "year_month").collect()}
    assert got == {("2025-01", "A"): 16.67, ("2025-01", "B"): 0.0, ("2024-01", "B"): 50.0}
    assert M.rate_by(with_period(df), "year").count() == 3


def test_conservation_across_groupings(spark):
    df = audit(spark).where("carrier is not null")
    for key in ("audit_date", "year_month", "year"):
        s = M.rate_by(df, key).agg(F.sum("released"), F.sum("retained")).first()
        assert tuple(s) == (26 - 3, 7 - 3)


def test_heat_funnel_share(spark):
    df = audit(spark)
    heat = {(r.weekday, r.carrier): r.retained_pct for r in M.heat_weekday(df).collect()}
    assert heat[("Tuesday", "A")] == 16.67
    f = [(r.stage_order, r.number) for r in M.funnel(df).orderBy("stage_order").collect()]
    assert f == [(0, 33), (1, 26), (2, 7)]
    shares = M.share(df, "operation").collect()
    assert abs(sum(r.share_pct for r in shares) - 100) < 0.02


def test_flight_metrics_a14_to_a21(spark):
    rows = [(D(2025, 3, 1), "OP-1", 10.0, 4.0), (D(2026, 3, 1), "OP-1", 5.0, 1.0),
            (D(2025, 3, 2), "OP-2", 3.0, 0.0), (D(2025, 3, 3), "OP-3", 9.0, 6.0)]
    df = spark.createDataFrame(rows, "flight_date date, operator string, routes double, flights double")
    prod = {tuple(r[:2]): r[2:] for r in M.production(df, ["month_abbr", "operator"]).collect()}
    assert prod[("MAR", "OP-1")] == (15.0, 5.0)  # T6: month label merges years
    k = M.flight_kpis(df).first()
    assert (k.total_flights, k.total_routes, k.operators) == (11, 27, 3)
    top = [(r.operator, r.rank, r.medal) for r in M.top_operators(df, 5).collect()]
    assert [t[0] for t in top] == ["OP-3", "OP-1", "OP-2"] and top[2][2] == M.MEDALS[2]
    eff = [(r.operator, r.routes_per_flight) for r in M.efficiency(df).collect()]
    assert eff == [("OP-1", 3.0), ("OP-3", 1.5)]
    goal = {r.operator: r.progress for r in M.goal_progress(df, "2025-03-10", goal=5).collect()}
    assert goal == {"OP-1": 1.0, "OP-2": 0.0, "OP-3": 1.0}
    assert M.month_projection(df, "2025-03-10").first().projection == 33


def test_count_categories_and_detail_a18_o3(spark):
    rows = [(D(2025, 1, 2), "OP", "chuva"), (D(2025, 1, 1), "OP", "CHUVA forte"), (D(2025, 1, 3), "OP", "zoom"),
            (D(2025, 1, 4), "OP", None), (D(2025, 1, 5), "OP", "nada")]
    df = spark.createDataFrame(rows, "flight_date date, operator string, notes string")
    got = [(r.category, r.occurrences) for r in M.count_categories(df).collect()]
    assert [g[1] for g in got] == [2, 1]
    det = O.occurrence_detail(df).collect()
    assert [r.flight_date for r in det] == [D(2025, 1, 1), D(2025, 1, 2), D(2025, 1, 3)]


def test_merge_report_a22_idempotent(spark):
    df = audit(spark)
    r = M.merge_report(df, df).first()
    assert (r.rows_before, r.rows_after, r.duplicates_ignored) == (10, 5, 5)


def test_notes_are_not_sent_to_the_driver_to_find_ranges_o3(spark):
    """the keys by which ranges are found hold hashes of a note, not the note."""
    rows = [(D(2025, 1, d), "OP", f"chuva {n}") for d in (2, 1) for n in (1, 2, 1)]
    out = O.occurrence_detail(spark.createDataFrame(rows, "flight_date date, operator string, notes string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = [x for line in plan.splitlines() if "rangepartitioning(" in line for x in line.split("rangepartitioning(")[1].split(" ASC")]
    assert keys and not any(k.strip(", ").startswith("notes#") for k in keys if "xxhash64" not in k)
    got = [(r.flight_date, r.notes) for r in out.collect()]
    assert [d for d, _ in got] == sorted(d for d, _ in got) and sorted(got) == sorted((d, n) for d, _, n in rows)
    for day in (1, 2):  # equal notes are side by side
        notes = [n for d, n in got if d == D(2025, 1, day)]
        assert sorted(notes) == ["chuva 1", "chuva 1", "chuva 2"] and notes[1] == "chuva 1"
