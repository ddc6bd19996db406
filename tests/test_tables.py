import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gatewatch.operators import tables as TB
from gatewatch.operators.ordering import sort_for_save
from gatewatch.schemas import FLIGHT_RAW
from gatewatch.sources import (append_table, export_report, read_csv, read_delimited, read_first,
                               read_parquet, replace_table, report_lines, snapshot, write_csv)

D = dt.date
SCHEMA = "audit_date date, carrier string, operation string, released double, retained double, total double, row_id string"


def table(spark):
    rows = [(D(2025, 1, 1), "A", "LML", 1.0, 0.0, 1.0, "r1"), (D(2025, 1, 2), "B", "LML", 2.0, 1.0, 3.0, "r2"),
            (D(2025, 1, 3), "C", "Direta", 3.0, 0.0, 3.0, "r3")]
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_import_u1_twice_changes_nothing(spark):
    t = table(spark)
    once = TB.merge_import(t, t)
    assert once.count() == 3
    assert TB.merge_import(once, t).count() == 3
    assert TB.merge_import(None, t).count() == 3


def test_append_u3_keeps_duplicates(spark):
    assert TB.append(table(spark), table(spark)).count() == 6


def test_apply_edits_u4_t19(spark):
    t = table(spark)
    scope = t.where("carrier in ('A', 'B')")
    edited = spark.createDataFrame([
        (D(2025, 1, 1), "A", "LML", 5.0, 1.0, None, "r1"),         # update
        (D(2025, 1, 4), "D", "Outros", 2.0, 2.0, None, "new-1"),   # insert
    ], SCHEMA)                                                     # r2 deleted
    got = {r.row_id: (r.released, r.retained, r.total) for r in TB.apply_edits(t, scope, edited).collect()}
    assert got == {"r1": (5.0, 1.0, 6.0), "r3": (3.0, 0.0, 3.0), "new-1": (2.0, 2.0, 4.0)}


def test_edit_keeps_the_totals_of_untouched_rows(spark):
    t = table(spark).withColumn("total", F.lit(None).cast("double"))
    edited = t.where("carrier = 'B'").withColumn("released", F.lit(7.0))
    from gatewatch.operators.metrics import audit_kpis
    for scope in (F.col("carrier") == "B", t.where("carrier = 'B'")):
        saved = TB.apply_edits(t, scope, edited)
        assert {r.carrier: r.total for r in saved.collect()} == {"A": 1.0, "B": 8.0, "C": 3.0}
        k = audit_kpis(saved).first()
        assert (k.total, k.retention_rate) == (12, 8.33)
    # rows that the predicate does not know stay
    gaps = t.withColumn("carrier", F.when(F.col("carrier") != "A", F.col("carrier")))
    assert TB.apply_edits(gaps, F.col("carrier") == "B", edited).count() == 3


def test_import_after_an_edit_finds_its_rows(spark):
    from gatewatch.operators.cleaning import clean_audit
    from gatewatch.schemas import AUDIT_RAW
    raw = spark.createDataFrame([(f"0{d}/03/2025", "ALFA", "LML", "4", "1", None) for d in (1, 2, 3)], AUDIT_RAW)
    stored = TB.merge_import(None, clean_audit(raw))
    day = F.col("audit_date") == D(2025, 3, 2)
    saved = TB.apply_edits(stored, day, stored.where(day).withColumn("released", F.lit(9.0)))
    for how in (None, "audit_date"):
        assert TB.merge_import(saved, clean_audit(raw), how).count() == 4


def test_merge_over_a_range(spark):
    t = table(spark)
    new = t.where("carrier = 'B'").unionByName(t.where("carrier = 'B'").withColumn("carrier", F.lit("Z")))
    undated = t.limit(1).withColumn("audit_date", F.lit(None).cast("date"))
    old = t.unionByName(undated)
    want = sorted(map(str, TB.merge_import(old, new).collect()))
    assert sorted(map(str, TB.merge_import(old, new, "audit_date").collect())) == want and len(want) == 5


def test_fields_are_written_as_they_are_k1(spark, tmp_path):
    rows = [("01/03/2025", "OP-1 ", "FIXO ", " 2", "1", "  nota  "), ("01/03/2025", "  ", "FIXO", "2", "1", " ")]
    df = spark.createDataFrame(rows, FLIGHT_RAW)
    write_csv(df, str(tmp_path / "padded"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "padded"), FLIGHT_RAW).collect())) == sorted(rows)


HEADERS = {"DATA": "05/03/2025", "TRANSPORTADORA": "ALFA", "OPERAÇÃO": "LML", "LIBERADOS": "12", "MALHA": "3"}


def test_columns_are_matched_by_name_s1_s2_s5(spark, tmp_path):
    """One folder: other orders, other delimiters, stray blanks in a header, an
    unknown column, no total; and an empty file."""
    from gatewatch.operators.cleaning import type_audit
    from gatewatch.schemas import AUDIT_RAW
    from gatewatch.sources.readers import upper
    folder = tmp_path / "in"
    folder.mkdir()
    orders = [list(HEADERS), list(HEADERS)[::-1], ["TRANSPORTADORA", "MALHA", "DATA", "LIBERADOS", "OPERAÇÃO"]]
    for k, (names, sep) in enumerate(zip(orders, [",", ";", "\t"])):
        (folder / f"{k}.csv").write_text(sep.join([f" {n.lower()} " if k == 2 else n for n in names] + ["EXTRA"]) + "\n"
                                         + sep.join([HEADERS[n] for n in names] + ["?"]) + "\n", encoding="utf-8")
    (folder / "empty.csv").write_text("")
    got = type_audit(read_delimited(spark, str(folder), AUDIT_RAW, key=upper)).collect()
    assert len(got) == 3 and {tuple(r) for r in got} == {(D(2025, 3, 5), "ALFA", "LML", 12.0, 3.0, 15.0)}
    one = read_csv(spark, str(folder / "0.csv"), AUDIT_RAW).first()
    assert (one.TRANSPORTADORA, one.LIBERADOS, one.MALHA, one["TOTAL TRANSPORTADORAS"]) == ("ALFA", "12", "3", None)


def test_unknown_layout_is_an_error(spark, tmp_path):
    from gatewatch.schemas import AUDIT_RAW
    (tmp_path / "x.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="none of the columns"):
        read_csv(spark, str(tmp_path / "x.csv"), AUDIT_RAW)


def test_saved_order_survives_k2_o2(spark, tmp_path):
    """Files of a replaced table hold ranges of dates that do not overlap."""
    path = str(tmp_path / "ordered")
    spark.range(4000).selectExpr("date_add(date'2020-01-01', cast(id * 7919 % 1500 as int)) AS audit_date",
                                 "concat('c', id % 5) AS carrier").write.parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files for few rows
    replace_table(sort_for_save(read_parquet(spark, path)), path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = read_parquet(spark, path).withColumn("file", F.col("_metadata.file_name"))
    spans = back.groupBy("file").agg(F.min("audit_date").alias("a"), F.max("audit_date").alias("b")).orderBy("file").collect()
    assert back.count() == 4000 and len(spans) > 1
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))
    assert sorted(os.listdir(tmp_path)) == ["ordered"]  # nothing is left beside it


def test_failed_replace_leaves_the_table_k2(spark, tmp_path):
    path = str(tmp_path / "kept")
    table(spark).write.parquet(path)
    broken = read_parquet(spark, path).withColumn("released", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        replace_table(broken, path)
    assert read_parquet(spark, path).count() == 3 and sorted(os.listdir(tmp_path)) == ["kept"]


def test_replace_catalog_table_k2(spark):
    table(spark).write.mode("overwrite").saveAsTable("kept_table")
    replace_table(spark.read.table("kept_table").where("carrier <> 'A'"), "kept_table")
    assert spark.read.table("kept_table").count() == 2
    assert [t.name for t in spark.catalog.listTables() if "kept_table" in t.name] == ["kept_table"]
    spark.sql("DROP TABLE kept_table")


def test_copies_keep_their_number_and_place_o2(spark):
    t = table(spark)
    many = t.unionByName(t).unionByName(t.where("carrier = 'C'"))
    got = [r.carrier for r in sort_for_save(many).collect()]
    assert got == ["A", "A", "B", "B", "C", "C", "C"]


def test_detail_is_in_order_o1(spark):
    from gatewatch.operators.ordering import detail
    rows = [(D(2025, 1, d), c, "LML", float(r), 1.0) for d in (3, 1, 2) for c in ("B", None, "A") for r in (2, 1)]
    df = spark.createDataFrame(rows, "audit_date date, carrier string, operation string, released double, retained double")
    got = [(r.audit_date, r.carrier or "", r.released) for r in detail(df).collect()]
    assert got == sorted(got)


def test_other_failures_are_raised_s4(spark):
    def broken():
        raise RuntimeError("store is down")
    with pytest.raises(RuntimeError):
        read_first(spark, [broken], FLIGHT_RAW)


def test_csv_round_trip_quotes_and_newlines_t1(spark, tmp_path):
    rows = [("01/03/2025", "OP-1", "FIXO", "20.0", "8.0", 'linha 1\nHÉLICE "quebrada", ok'),
            ("02/03/2025", "OP-2", "RESERVA", "1", "0", None)]
    df = spark.createDataFrame(rows, FLIGHT_RAW)
    out = str(tmp_path / "voos")
    write_csv(df, out)
    back = read_csv(spark, out, schema=FLIGHT_RAW)
    assert sorted(back.collect(), key=lambda r: r.Data) == sorted(df.collect(), key=lambda r: r.Data)


def test_read_delimited_sniffs_separator_s2(spark, tmp_path):
    semi = tmp_path / "semi.csv"
    semi.write_text("DATA;TRANSPORTADORA;LIBERADOS\n05/03/2025;ALFA;1.234\n", encoding="utf-8")
    comma = tmp_path / "comma.csv"
    comma.write_text("DATA,TRANSPORTADORA,LIBERADOS\n05/03/2025,ALFA,12\n", encoding="utf-8")
    a = read_delimited(spark, str(semi)).first()
    b = read_delimited(spark, str(comma)).first()
    assert (a.TRANSPORTADORA, a.LIBERADOS) == ("ALFA", "1.234")
    assert (b.TRANSPORTADORA, b.LIBERADOS) == ("ALFA", "12")


def test_replace_append_snapshot_k2_k3_k4(spark, tmp_path):
    path = str(tmp_path / "tbl")
    table(spark).write.parquet(path)
    current = read_parquet(spark, path)
    # a table can be replaced by a plan that reads it
    replace_table(current.where("carrier <> 'A'"), path)
    assert spark.read.parquet(path).count() == 2
    append_table(table(spark).where("carrier = 'A'"), path)
    assert spark.read.parquet(path).count() == 3
    snap = snapshot(spark.read.parquet(path), str(tmp_path / "backup"), "t1")
    assert spark.read.parquet(snap).count() == 3


def test_export_and_report_lines_k5_k6(spark, tmp_path):
    out = str(tmp_path / "report")
    export_report(table(spark), out)
    back = read_csv(spark, out)
    assert sorted(r.audit_date for r in back.collect()) == ["01/01/2025", "02/01/2025", "03/01/2025"]
    f = spark.createDataFrame([("OP-1", 8.0, 20.0)], "operator string, flights double, routes double")
    assert report_lines(f, str(tmp_path / "lines")).first().value == "OP-1 - 8.0 voos - 20.0 rotas"
    assert os.path.isdir(str(tmp_path / "lines"))


def test_read_first_falls_back_to_typed_empty_s4(spark, tmp_path):
    from gatewatch.schemas import AUDIT

    def missing():
        return spark.read.parquet(str(tmp_path / "nope"))

    def empty():
        return spark.createDataFrame([], AUDIT)

    got = read_first(spark, [missing, empty], AUDIT)
    assert got.count() == 0 and got.schema == AUDIT
    assert read_first(spark, [missing, lambda: table(spark)], AUDIT).count() == 3


def test_sort_for_save_o2(spark):
    got = [r.audit_date for r in sort_for_save(table(spark).orderBy("carrier", ascending=False)).collect()]
    assert got == sorted(got)


def test_upload_folder_forward_fill_per_file_p9_s2(spark, tmp_path):
    from gatewatch.operators.cleaning import import_flights
    from gatewatch.sources import read_upload
    folder = tmp_path / "upload"
    folder.mkdir()
    head = "Data;Operador;Tipo;Rotas;Voos;Obs\n"
    (folder / "a.csv").write_text(head + "01/03/2025;OP-1;FIXO;2;1;\n;OP-2;FIXO;3;1;\"linha 1\nlinha 2\"\n"
                                  "  ;OP-3;FIXO;1;1;\n", encoding="utf-8")
    (folder / "b.csv").write_text(head + ";OP-9;FIXO;1;1;\n05/03/2025;OP-4;RESERVA;1,5;1;\n;OP-5;FIXO;1;0;\n",
                                  encoding="utf-8")
    raw = read_upload(spark, str(folder))
    got = sorted((r.operator, r.flight_date.isoformat()) for r in
                 import_flights(raw, order_by="row_no", file_col="source_file").collect())
    # b.csv starts with a gap: nothing before it in that file, so OP-9 is dropped
    assert got == [("OP-1", "2025-03-01"), ("OP-2", "2025-03-01"), ("OP-3", "2025-03-01"),
                   ("OP-4", "2025-03-05"), ("OP-5", "2025-03-05")]


def test_read_table_case_insensitive_s3(spark, tmp_path):
    from gatewatch.sources import read_table
    table(spark).createOrReplaceTempView("Performance_Logistica")
    assert read_table(spark, "performance_logistica").count() == 3
    path = str(tmp_path / "as_path")
    table(spark).write.parquet(path)
    assert read_table(spark, path).count() == 3


def test_a_row_with_millions_of_copies_o2_u4(spark, monkeypatch):
    """Copies of one row are put back by many tasks, in place."""
    from pyspark.sql import functions as F

    from gatewatch.operators import ordering as O
    hot = spark.range(5_000_000, numPartitions=4).select(F.lit("2024-05-02").cast("date").alias("audit_date"), F.lit("A").alias("carrier"))
    rest = spark.createDataFrame([("2024-05-01", "Z"), ("2024-05-02", "B"), ("2024-05-03", None), (None, "A")], "d string, carrier string")
    df = hot.unionByName(rest.select(F.col("d").cast("date").alias("audit_date"), "carrier"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = O.sort_for_save(df)
        per = out.groupBy(F.spark_partition_id().alias("p"), "audit_date", "carrier").count().collect()
        assert sum(r["count"] for r in per) == 5_000_004
        of_hot = [r["count"] for r in per if r.carrier == "A" and r.audit_date]
        assert len(of_hot) == 4 and sum(of_hot) == 5_000_000 and max(of_hot) < 3_000_000
        order = sorted(((r.p, r.audit_date is not None, str(r.audit_date), r.carrier or "") for r in per))
        assert [x[1:] for x in order] == sorted(x[1:] for x in order)  # ranges follow each other
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(O, "CHUNK", 3)
    few = spark.createDataFrame([("2024-01-01", "A")] * 10 + [("2024-01-01", "B")] * 3 + [("2023-01-01", "C")], "d string, carrier string")
    got = [tuple(r) for r in O.sort_for_save(few, "d").collect()]
    assert got == [("2023-01-01", "C")] + [("2024-01-01", "A")] * 10 + [("2024-01-01", "B")] * 3


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_held_in_a_table_of_groups_to_be_sorted_o2(spark):
    """copies are numbered, not counted in hash tables of whole rows."""
    from gatewatch.operators.ordering import detail
    for out in (sort_for_save(table(spark)), detail(table(spark).select("audit_date", "carrier", "operation", "released", "retained"))):
        assert "Aggregate" not in _plan(out)


def test_copies_of_equal_and_other_rows_stay_o2(spark, monkeypatch):
    """nulls, signed zeros and copies from several partitions all stay."""
    from gatewatch.operators import ordering as O
    monkeypatch.setattr(O, "CHUNK", 2)
    rows = [(None, None, 0.0)] * 5 + [(D(2024, 1, 1), None, 1.0)] * 7 + [(D(2024, 1, 1), "A", -0.0)] * 3
    df = spark.createDataFrame(rows, "audit_date date, carrier string, released double").repartition(5)
    got = [(r.audit_date, r.carrier, str(r.released)) for r in O.sort_for_save(df).collect()]
    assert got == [(d, c, str(x)) for d, c, x in rows]


def test_headers_are_found_without_sorting_lines_s2(spark, tmp_path):
    """whatever blocks the files are read in, and without holding their lines."""
    from gatewatch.sources.readers import first_lines, header_lines
    for name, head in (("a", "x;y"), ("b", ""), ("c", "x,y")):
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "".join(f"{k};b\n" for k in range(3000)))
    (tmp_path / "d.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = first_lines(spark, str(tmp_path))
        assert "SortAggregate" not in _plan(lines)
        assert sorted((r.file[-5:], r.header) for r in lines.collect()) == [("a.csv", "x;y"), ("b.csv", ""), ("c.csv", "x,y")]
        assert {h: [f[-5:] for f in fs] for h, fs in header_lines(spark, str(tmp_path)).items()} == {
            "x;y": ["a.csv"], "": ["b.csv"], "x,y": ["c.csv"]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
