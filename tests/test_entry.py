import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from gatewatch.plans.catalog import QUERIES
from oracle_check import TABLES, digest

SMOKE = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year_month", "carrier", "released", "retained", "retained_pct",
                          "released_label", "retained_pct_label"]
    assert df.count() > 0


def test_every_query_has_oracle_sql():
    assert {q.name for q in QUERIES} == {q.name for q in QUERIES if q.sql}
    assert {q.name for q in QUERIES} <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_every_inventory_operator_is_covered():
    want = ({f"S{k}" for k in range(1, 6)} | {f"K{k}" for k in range(1, 7)} | {f"P{k}" for k in range(1, 24)}
            | {f"F{k}" for k in range(1, 15)} | {f"D{k}" for k in range(1, 6)} | {f"A{k}" for k in range(1, 23)}
            | {"W1"} | {f"O{k}" for k in range(1, 5)} | {f"U{k}" for k in range(1, 6)})
    assert want <= {i for q in QUERIES for i in q.covers}


def test_importable_without_the_optional_part(tmp_path):
    """A copy of the library without the training-data part still registers its queries."""
    here = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(here, "gatewatch"), tmp_path / "gatewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(E.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(QUERIES)), "False"]


@pytest.mark.parametrize("name", ["notes_count_default", "notes_classify_default", "flights_no_operator_selected",
                                  "flights_operators_selected", "audit_filter_carriers"])
def test_queries_can_fail(spark, name):
    """Their results are neither empty nor all null."""
    rows = E.queries()[name](spark, SMOKE).collect()
    assert rows and any(x is not None for r in rows for x in r)
    if name.endswith("default"):
        assert len({r.category for r in rows if r.category is not None}) == 4


@pytest.mark.parametrize("name", ["audit_validate_records", "flights_validate_records"])
def test_both_valid_and_invalid_records(spark, name):
    found = {r.is_valid for r in E.queries()[name](spark, SMOKE).select("is_valid").distinct().collect()}
    assert found == {True, False}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMOKE, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(q.name for q in QUERIES))
def test_query_matches_oracle_sf0001(spark, duck, name):
    sdf = E.queries()[name](spark, SMOKE)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(sdf.columns, s_rows) == digest(d_cols, d_rows)
