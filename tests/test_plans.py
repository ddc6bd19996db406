"""Plan guards for every query of the inventory: no cartesian or nested-loop
joins and no Python in the plan."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from gatewatch.plans.catalog import QUERIES

SMOKE = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(q.name for q in QUERIES))
def test_plan_has_no_cross_join_or_python(spark, name):
    text = plan_text(E.queries()[name](spark, SMOKE))
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"


def test_texts_are_parsed_once(spark):
    """The filter on a parsed date stays above the parser."""
    text = plan_text(E.queries()["audit_clean"](spark, SMOKE))
    filters = [x for x in text.split("\n\n") if "Filter" in x.split("\n")[0]]
    assert filters and not any("try_to_date" in x or "gettimestamp" in x for x in filters)


def test_merge_over_a_range_shuffles_only_that_range(spark, tmp_path):
    """The stored rows outside the import's dates are read under a date
    predicate and reach the result without an exchange."""
    from gatewatch.operators.tables import merge_import
    df = spark.createDataFrame([], "audit_date date, carrier string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    df.write.parquet(old), df.write.parquet(new)
    text = plan_text(merge_import(spark.read.parquet(old), spark.read.parquet(new), "audit_date"))
    assert text.count("Scan parquet") >= 3 and "Union" in text


def test_year_filter_reaches_scan_as_date_ranges(spark, tmp_path):
    from gatewatch.operators.filters import filter_audit
    df = spark.createDataFrame([], "audit_date date, carrier string, operation string, released long, retained long")
    path = str(tmp_path / "audit")
    df.write.parquet(path)
    text = plan_text(filter_audit(spark.read.parquet(path), years=[2024, 2025], operations=["LML"]))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(audit_date" in text
    assert "In(operation" in text or "EqualTo(operation" in text
