from gatewatch.streaming import import_stream


def test_import_stream_dedupes_against_table(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    header = "DATA,TRANSPORTADORA,OPERAÇÃO,LIBERADOS,MALHA,TOTAL TRANSPORTADORAS\n"
    (landing / "a.csv").write_text(header + "05/03/2025,ALFA,LML,12,3,15\n05/03/2025,ALFA,LML,12,3,15\n"
                                   "sem data,BETA,LML,1,1,2\n", encoding="utf-8")
    target = str(tmp_path / "audit")
    q = import_stream(spark, str(landing), target, str(tmp_path / "ckpt"), kind="audit")
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 1
    (landing / "b.csv").write_text(header + "05/03/2025,ALFA,LML,12,3,15\n06/03/2025,BETA,Direta,7,0,7\n",
                                   encoding="utf-8")
    q = import_stream(spark, str(landing), target, str(tmp_path / "ckpt"), kind="audit")
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 2


def test_import_stream_flights(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "v.csv").write_text(
        "Data,Operador,Tipo,Rotas,Voos,Obs\n01/03/2025,OP-1 ,FIXO,20.0,8.0,\"linha 1\nlinha 2\"\n"
        "01/03/2025,OP-1 ,FIXO,20.0,8.0,\"linha 1\nlinha 2\"\n02/03/2025,,RESERVA,,1,\n", encoding="utf-8")
    target = str(tmp_path / "voos")
    q = import_stream(spark, str(landing), target, str(tmp_path / "ckpt"), kind="flights")
    q.awaitTermination(120)
    got = sorted((r.operator, r.routes, r.notes) for r in spark.read.parquet(target).collect())
    assert got == [("Não Informado", 0.0, None), ("OP-1", 20.0, "linha 1\nlinha 2")]


def test_import_stream_fills_dates_and_keeps_rejects(spark, tmp_path):
    """Merged cells are filled per file; rows without any date are written out."""
    landing = tmp_path / "landing"
    landing.mkdir()
    head = "Operador;Data;Tipo;Rotas;Voos;Obs\n"  # another order and delimiter than the log's
    (landing / "a.csv").write_text(head + "OP-1;01/03/2025;FIXO;2;1;\nOP-2;;FIXO;3;1;\n", encoding="utf-8")
    (landing / "b.csv").write_text(head + "OP-3;;FIXO;2;1;\n", encoding="utf-8")
    target = str(tmp_path / "voos")
    import_stream(spark, str(landing), target, kind="flights").awaitTermination(120)
    assert sorted(r.operator for r in spark.read.parquet(target).collect()) == ["OP-1", "OP-2"]
    assert [r.operator for r in spark.read.parquet(target + "__rejects").collect()] == ["OP-3"]


def test_streams_of_one_kind_have_their_own_progress(spark, tmp_path):
    header = "DATA,TRANSPORTADORA,OPERAÇÃO,LIBERADOS,MALHA\n"
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(header + f"05/03/2025,{name},LML,12,3\n", encoding="utf-8")
        q = import_stream(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), kind="audit", max_files=1)
        q.awaitTermination(120)
        assert [r.carrier for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()] == [name]


def test_an_unreadable_table_is_an_error(spark, tmp_path):
    import pytest
    from gatewatch.streaming.importer import merge_batch
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part-0.parquet").write_bytes(b"not a table")
    batch = spark.createDataFrame([("x",)], "carrier string").selectExpr("date'2025-01-01' AS audit_date", "carrier")
    with pytest.raises(Exception):
        merge_batch(batch, str(tmp_path / "table"))
