"""Report files: header flattening, round trip through a landing folder, streaming."""

import os
import uuid

from ventanilla.plans import views as V
from ventanilla.plans.file_queries import report_file_ingest, stream_ingest
from ventanilla.session import scratch_path
from ventanilla.sources import reports

from conftest import SF_SMALL


def test_s4_header_flattening(spark):
    cells = spark.createDataFrame([(7, 16, ["A", "CAPTURA", "", ""]), (7, 17, ["", "INICIO", "FIN", ""])],
                                  "archivo_id bigint, row_no bigint, cells array<string>")
    got = reports.flatten_headers(cells, 16, strip_parts=True).collect()[0]["columnas"]
    assert got == ["A", "CAPTURA_INICIO", "FIN", "col_sin_nombre"]


def test_s4_repeated_names_get_position(spark):
    cells = spark.createDataFrame([(1, 1, ["X", "X", "Y"]), (1, 2, ["", "", ""])],
                                  "archivo_id bigint, row_no bigint, cells array<string>")
    assert reports.flatten_headers(cells, 1, False).collect()[0]["columnas"] == ["X", "X_2", "Y"]


def test_landing_round_trip_equals_direct_rows(spark):
    got = report_file_ingest(spark, SF_SMALL).drop("nombre_archivo")
    ref = V.sol_rows(spark, SF_SMALL).select("mac", "row_no", "fecha", "folio", "categoria", "funcionario",
                                             "terminal", "centesimas")
    ref = ref.withColumn("row_no", ref.row_no + 23)
    assert got.count() == ref.count()
    assert got.exceptAll(ref).count() == 0


def test_stream_ingest_equals_batch_facts(spark):
    facts = stream_ingest(spark, SF_SMALL)
    assert facts.count() == V.sol_facts(spark, SF_SMALL).count()


def test_t2_a_replayed_batch_replaces_its_own_output(spark, tmp_path):
    from ventanilla.streaming import ingest
    out = str(tmp_path / "out")
    head = "\n".join([f"{n}\t" for n in range(1, 21)] + ["21\tTERMINAL\tSOLICITUD\tFECHA DE TRAMITE\tTRAMITE\tNOMBRE FUNCIONARIO", "22\t\t\t\t\t"])
    (tmp_path / "Rep_TiemAten_SOL_090852_1.xls").write_text(head + "\n23\tT1\tS1\t03/03/2026\tInscripción\tANA\n24\tT1\tS2\t03/03/2026\tReposición\tANA\n")
    (tmp_path / "Rep_TiemAten_SOL_090852_2.xls").write_text("1\tsin encabezado\n")
    lines = spark.read.text(str(tmp_path / "*.xls")).select("value", "_metadata")
    for _ in range(2):
        ingest.ingest_batch(lines, 7, out)
    facts = spark.read.parquet(os.path.join(out, "facts"))
    assert sorted((r.folio, r.mac, r.categoria, r.batch_id) for r in facts.collect()) == [
        ("S1", "090852", "INSCRIPCION", 7), ("S2", "090852", "REPOSICION", 7)]
    ledger = spark.read.parquet(os.path.join(out, "ledger"))
    final = {r.nombre_archivo[-5]: r.estatus for r in ledger.where("seq = 1").collect()}
    assert ledger.count() == 4 and final == {"1": "PROCESADO", "2": "ERROR"}


def test_a_stream_without_accepted_files_has_no_facts(spark, tmp_path):
    from ventanilla.plans import file_queries
    from ventanilla.streaming import ingest
    landing = tmp_path / "landing" / "reporte=Rep_TiemAten_SOL_090852_1.xls"
    landing.mkdir(parents=True)
    # the one data row has no date, so the gate refuses its file
    (landing / "a.txt").write_text("21\tTERMINAL\tSOLICITUD\tFECHA DE TRAMITE\tTIPO DE TRAMITE\tNOMBRE FUNCIONARIO\n22\t\t\t\t\t\n"
                                   "23\tT1\tS1\tsin fecha\tInscripción\tANA\n")
    out = file_queries._streamed(spark, str(tmp_path / "landing"))
    assert ingest.stored(spark, out, "facts").count() == 0 and ingest.stored(spark, out, "facts_cr").count() == 0
    assert [r.estatus for r in spark.read.parquet(os.path.join(out, "ledger")).where("seq = 1").collect()] == ["ERROR"]
    ingest.compact(spark, out, str(tmp_path / "compact"))


def test_of_equal_type_headers_the_last_one_a_row_reaches_counts(spark):
    rows = [(1, "f", 1, ["A", "TRAMITE", " tramite "]), (1, "f", 2, ["", "", ""]), (1, "f", 3, ["x", "y", "z"]), (1, "f", 4, ["x", "y"]), (1, "f", 5, [])]
    cells = spark.createDataFrame(rows, "archivo_id bigint, nombre_archivo string, row_no bigint, cells array<string>")
    got = reports.report_rows(cells, ["A", "TRAMITE", "B"], 1, False, any_case=["TRAMITE"])
    assert sorted((r.row_no, r.A, r.TRAMITE, r.B) for r in got.collect()) == [(3, "x", "z", None), (4, "x", "y", None), (5, None, None, None)]
    plan = reports.flatten_headers(cells, 1, False)._jdf.queryExecution().toString()
    assert "Join" not in plan  # both header rows in one reading


def test_a_query_parses_every_report_once(spark, monkeypatch):
    parsed = []
    was_by_key = V.store.ingest_by_key
    monkeypatch.setattr(V.store, "ingest_by_key", lambda *a, **k: (parsed.append(1), was_by_key(*a, **k))[1])
    V.facts_and_catalog(spark, SF_SMALL, ["archivo_id"], ["archivo_id"])
    assert len(parsed) == 2


def test_list_reports_prunes_content(spark, tmp_path):
    for n in ["Rep_TiemAten_SOL_090852_a.xls", "x_cr_090853.xlsx", "notes.txt"]:
        (tmp_path / n).write_text("x")
    got = sorted((r.archivo, r.mac, r.tipo) for r in reports.list_reports(spark, str(tmp_path)).collect())
    assert got == [("Rep_TiemAten_SOL_090852_a.xls", "090852", "TIEMPOS_SOL"), ("x_cr_090853.xlsx", "090853", "TIEMPOS_CR")]


def test_s9_export_then_s7_read_back(spark, tmp_path):
    from pyspark.sql import functions as F
    from ventanilla.operators import compare, export, metrics
    from ventanilla.plans import views as V
    rows = V.sol_rows(spark, SF_SMALL)
    out = export.export_rows(metrics.clerk_metrics(rows), metrics.global_threshold(rows))
    out = out.withColumn("tipo", F.lit("tiempos_sol")).withColumn("reporte", export.report_name(F.lit("Rep_SOL_1.xls")))
    target = str(tmp_path / "output")
    export.write_reports(out.drop("archivo_id"), target)
    back = reports.read_csv_report(spark, os.path.join(target, "tipo=tiempos_sol", "reporte=Rep_SOL_1_reporte_funcionarios"))
    assert back.count() == out.count()
    view = compare.sol_report_view(back)
    assert "sol_tramites" in view.columns and view.where("sol_tramites < 0").count() == 0


def test_s7_bom_and_repeated_header(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes("﻿Funcionario , Entregas,entregas\nA,1,2\n".encode("utf-8"))
    df = reports.read_csv_report(spark, str(p))
    assert df.columns[0] == "funcionario"
    view = __import__("ventanilla.operators.compare", fromlist=["x"]).cr_report_view(df)
    assert [tuple(r) for r in view.select("funcionario", "cr_cantidad").collect()] == [("A", 1.0)]


def test_s6_latest_file(spark, tmp_path):
    for i, n in enumerate(["a_SOL_.xls", "b_SOL_.xls"]):
        f = tmp_path / n
        f.write_text("x")
        os.utime(f, (1_000_000 + i * 100, 1_000_000 + i * 100))
    files = reports.list_reports(spark, str(tmp_path))
    assert reports.latest_file(files).collect()[0]["path"].endswith("b_SOL_.xls")
