"""A whole flight log as operators keep it: invented rows of the usual shape,
with quoted newlines, padded names, blanks and a second year."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatewatch.functions.classify import DEFAULT_RULES
from gatewatch.operators import cleaning as C
from gatewatch.operators import metrics as M
from gatewatch.schemas import FLIGHT_RAW
from gatewatch.sources import read_csv

NOTES = ["", "", "CHUVA FORTE", "linha 1\nHÉLICE quebrada", "FALTA", "virada", "sem alteração", "CHUVA e ZOOM ruim"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "voos.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("Data,Operador,Tipo,Rotas,Voos,Obs\n")
        for k in range(400):
            day = dt.date(2025, 1, 1) + dt.timedelta(days=k)
            note = NOTES[k % 8].replace("\n", "\r\n" if k % 16 == 3 else "\n")
            name = ["OP-1", "OP-2", "OP-3 ", ""][k % 4]
            f.write(f"{day:%d/%m/%Y},{name},{'FIXO ' if k % 10 == 0 else 'FIXO'},{k % 7}.0,{k % 3}.0,\"{note}\"\n")
    return read_csv(spark, str(path), FLIGHT_RAW).cache()


def test_records_and_sums(raw):
    f = C.clean_flights(raw)
    k = f.agg(F.count("*"), F.sum("routes"), F.sum("flights"), F.min("flight_date"), F.max("flight_date")).first()
    assert tuple(k) == (400, float(sum(i % 7 for i in range(400))), float(sum(i % 3 for i in range(400))),
                        dt.date(2025, 1, 1), dt.date(2026, 2, 4))


def test_operators_types_and_notes(raw):
    assert {r.operator for r in C.clean_flights(raw).select("operator").distinct().collect()} == {
        "OP-1", "OP-2", "OP-3", "Não Informado"}
    assert {r[0]: r[1] for r in raw.groupBy("Tipo").count().collect()} == {"FIXO": 360, "FIXO ": 40}
    assert raw.where(F.col("Obs").contains("\n")).count() == 50


def test_month_label_merges_years_t6(raw):
    f = C.clean_flights(raw)
    assert M.production(f, ["month_abbr"]).count() == 12
    assert M.production(C.with_period(f, "flight_date"), ["year_month"]).count() == 14


def test_categories_t14(raw):
    cat = M.with_category(C.clean_flights(raw).where(F.col("notes").isNotNull()), DEFAULT_RULES)
    counts = {r[0]: r[1] for r in cat.where("category IS NOT NULL").groupBy("category").count().collect()}
    names = [c for c, _ in DEFAULT_RULES]
    assert counts == {names[0]: 100, names[1]: 50, names[2]: 50, names[3]: 50}
