"""Bounds of the data from file footers."""

import contextlib
import datetime as dt
import io

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import filters as FL
from gatewatch.sources import stored_bounds, store_by_month
from gatewatch.sources import bounds as B

D = dt.date


@pytest.fixture
def table(spark):
    days = [D(2024, 1, 5), D(2024, 2, 29), D(2024, 3, 10), D(2024, 3, 13), None]
    rows = [(d, f"c{k % 2}", "LML", k, 1) for k, d in enumerate(days * 3)]
    return spark.createDataFrame(rows, "audit_date date, carrier string, operation string, released long, retained long")


def test_bounds_come_from_footers(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.repartition(3).write.parquet(path)
    assert stored_bounds(spark, path, "audit_date") == (D(2024, 1, 5), D(2024, 3, 13))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with B._footers_answer(spark), contextlib.redirect_stdout(io.StringIO()) as out:
        B.footer_ends(spark, [path], "audit_date").explain("formatted")
    assert "PushedAggregation: [MIN(audit_date), MAX(audit_date)]" in out.getvalue()
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_tables_by_month(spark, table, tmp_path):
    path = str(tmp_path / "v")
    store_by_month(table, path)
    assert stored_bounds(spark, path, "audit_date") == (D(2024, 1, 5), D(2024, 3, 13))


def test_files_without_statistics_are_read(spark, table, tmp_path):
    path = str(tmp_path / "t")
    table.coalesce(1).write.option("parquet.column.statistics.enabled", "false").parquet(path)
    file = next((tmp_path / "t").glob("*.parquet"))
    assert not pq.ParquetFile(file).metadata.row_group(0).column(0).is_stats_set
    assert stored_bounds(spark, path, "audit_date") == (D(2024, 1, 5), D(2024, 3, 13))


def test_other_types_and_no_dates(spark, table, tmp_path):
    for name, df, expected in [
            ("empty", table.limit(0), (None, None)),
            ("nulls", table.where("audit_date IS NULL"), (None, None)),
            ("time", table.withColumn("audit_date", F.col("audit_date").cast("timestamp")), (D(2024, 1, 5), D(2024, 3, 13)))]:
        df.write.parquet(str(tmp_path / name))
        assert stored_bounds(spark, str(tmp_path / name), "audit_date") == expected, name


@pytest.mark.parametrize("where", ["true", "false", "audit_date IS NULL", "audit_date = DATE '2024-03-10'"])
def test_filters_give_the_same_rows(table, where):
    df = table.where(where)
    bounds = tuple(df.agg(F.min("audit_date"), F.max("audit_date")).first())

    def rows(out):
        return sorted(map(str, out.collect()))

    for make in (lambda **k: FL.last_data_days(df, 5, **k), lambda **k: FL.current_week(df, **k),
                 lambda **k: FL.single_day(df, **k), lambda **k: FL.single_day(df, carriers=["c1"], **k),
                 lambda **k: FL.timeline(df, "2024-04-01", date_col="audit_date", **k),
                 lambda **k: FL.date_bounds(df, "2024-04-01", **k)):
        assert rows(make(bounds=bounds)) == rows(make())
