"""The fact store, the arrival gate, content digests and the ledger's state machine."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ventanilla.operators import dashboard, intake, rollups
from ventanilla.plans import views as V
from ventanilla.plans.store_queries import new_store
from ventanilla.sources.fact_store import EVENTS, Batch
from ventanilla.streaming import ledger
from ventanilla.streaming.intake import cells_of, ingest_files, start_intake

from conftest import SF_SMALL

HEAD = [f"{n}\t" for n in range(1, 21)] + ["21\tTERMINAL\tSOLICITUD\tFECHA DE TRAMITE\tTIPO DE TRAMITE\tNOMBRE FUNCIONARIO", "22\t\t\t\t\t"]


def report(folder, name, rows, head=HEAD):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(head + [f"{23 + k}\t{r}" for k, r in enumerate(rows)]) + "\n")
    return path


def listed(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "modificationTime")


def rows_of(n, day="03/03/2026"):
    return [f"T1\tS{k}\t{day}\tInscripción\tANA" for k in range(n)]


def test_a_batch_that_dies_between_two_tables_shows_nothing(spark, tmp_path, monkeypatch):
    s = new_store(spark)
    report(tmp_path / "in", "Rep_TiemAten_SOL_090852_1.xls", rows_of(3))
    put = Batch.put

    def dying(self, name, rows):
        if name == "bitacora":
            raise RuntimeError("executor lost")
        return put(self, name, rows)

    monkeypatch.setattr(Batch, "put", dying)
    with pytest.raises(RuntimeError):
        ingest_files(s, 0, listed(spark, tmp_path / "in"))
    assert os.path.isdir(s.path("tramites"))
    assert s.table("tramites").count() == s.table("arribos").count() == s.table("resumen_sol").count() == intake.catalog(s).count() == 0
    monkeypatch.undo()
    for _ in range(2):  # a batch run again replaces what it had confirmed
        ingest_files(s, 0, listed(spark, tmp_path / "in"))
        assert s.table("tramites").count() == 3 and s.table("arribos").count() == 1
        assert [(r.estatus, r.registros_insertados) for r in intake.catalog(s).collect()] == [("PROCESADO", 3)]
    assert s.confirmed().count() == 1 and not os.listdir(s.path("obra")) == []  # the dead try's work area stays, read by nobody


def test_every_file_has_one_last_state(spark, tmp_path):
    s = new_store(spark)
    folder = tmp_path / "in"
    report(folder, "Rep_TiemAten_SOL_090852_1.xls", rows_of(2))
    report(folder, "Rep_TiemAten_SOL_090853_2.xls", rows_of(2))
    report(folder, "Rep_TiemAten_SOL_090852_3.xls", rows_of(2, "sin fecha"))
    report(folder, "Rep_TiemAten_SOL_090852_4.xls", rows_of(1), head=[])
    report(folder, "TRAMITES_090852.xls", rows_of(1))
    open(folder / "Rep_TiemAten_CR_090852_5.xls", "w").close()
    up = [(n, "TIEMPOS_SOL" if "SOL" in n else None, 2, "090852", datetime(2026, 1, k + 1)) for k, n in enumerate(sorted(os.listdir(folder)))]
    uploads = spark.createDataFrame(up, "nombre_archivo string, tipo_esperado string, role_id bigint, mac_usuario string, fecha_carga timestamp_ntz")
    start_intake(s, str(folder), s.path("_avance"), uploads, files_per_batch=2).awaitTermination()
    got = {r.nombre_archivo: (r.estatus, r.motivo) for r in intake.destinations(s).collect()}
    assert got == {
        "Rep_TiemAten_SOL_090852_1.xls": ("PROCESADO", ""), "Rep_TiemAten_SOL_090853_2.xls": ("RECHAZADO", "mac_ajeno"),
        "Rep_TiemAten_SOL_090852_3.xls": ("ERROR", 'null value in column "fecha" violates not-null constraint'),
        "Rep_TiemAten_SOL_090852_4.xls": ("ERROR", "Sin renglones de encabezado"),
        "TRAMITES_090852.xls": ("PENDIENTE", ""), "Rep_TiemAten_CR_090852_5.xls": ("ERROR", "Archivo vacío")}
    assert s.table("tramites").select("nombre_archivo").distinct().collect()[0][0] == "Rep_TiemAten_SOL_090852_1.xls"
    assert s.confirmed().count() == 3
    assert {r.nombre_archivo: r.fecha_carga for r in intake.catalog(s).collect()} == {u[0]: u[4] for u in up if "090853" not in u[0]}


@pytest.mark.parametrize("refuse", [True, False])
def test_the_same_content_under_a_new_name(spark, tmp_path, refuse):
    s = new_store(spark)
    for k, name in enumerate(["Rep_TiemAten_SOL_090852_1.xls", "Rep_TiemAten_SOL_090852_otra.xls", "Rep_TiemAten_SOL_090853_1.xls"]):
        report(tmp_path / str(k), name, rows_of(4))
    report(tmp_path / "0", "Rep_TiemAten_SOL_090852_2.xls", rows_of(5))
    ingest_files(s, 0, listed(spark, tmp_path / "0"), refuse_repeats=refuse)
    ingest_files(s, 1, listed(spark, tmp_path / "1").unionByName(listed(spark, tmp_path / "2")), refuse_repeats=refuse)
    states = sorted(r.estatus for r in intake.destinations(s).collect())
    assert states == (["PROCESADO"] * 2 + ["RECHAZADO"] * 2 if refuse else ["PROCESADO"] * 4)
    assert s.table("tramites").count() == (9 if refuse else 17)
    assert s.table("arribos").select("archivo_id").distinct().count() == 4
    ingest_files(s, 0, listed(spark, tmp_path / "0"), refuse_repeats=refuse)  # a retried batch does not refuse its own files
    assert s.table("tramites").count() == (9 if refuse else 17)


def test_digest_does_not_depend_on_splits(spark, tmp_path):
    paths = [report(tmp_path, "a_SOL_.xls", rows_of(500)), report(tmp_path, "b_SOL_.xls", rows_of(500)), report(tmp_path, "c_SOL_.xls", rows_of(500)[::-1])]
    cells = cells_of(spark, paths)
    one = {r.archivo_id: r.huella for r in intake.content_digests(cells).collect()}
    many = {r.archivo_id: r.huella for r in intake.content_digests(cells.repartition(7).sortWithinPartitions(F.col("row_no").desc())).collect()}
    assert one == many and len(one) == 3 and len(set(one.values())) == 2


def test_rollups_equal_the_direct_metrics(spark):
    facts, facts_cr = V.sol_facts(spark, SF_SMALL).persist(), V.cr_facts(spark, SF_SMALL).persist()
    sol, cr = rollups.sol_rollup(facts), rollups.cr_rollup(facts_cr)
    for got, want in [(rollups.file_summary(sol), dashboard.file_summary(facts)), (rollups.cr_summary(cr), dashboard.cr_summary(facts_cr)),
                      (rollups.clerk_list(sol), dashboard.clerk_ranking(facts).drop("posicion")), (rollups.terminal_list(cr), dashboard.cr_by_terminal(facts_cr))]:
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


# --- state machine ------------------------------------------------------------------

def event(seq, status):
    return {"seq": seq, "estatus": status}


@pytest.mark.parametrize("events, states, last", [
    ([event(0, "PENDIENTE"), event(1, "PROCESADO")], ["PENDIENTE", "PROCESADO"], "PROCESADO"),
    ([event(1, "ERROR"), event(0, "PENDIENTE")], ["PENDIENTE", "ERROR"], "ERROR"),
    ([event(0, "PENDIENTE"), event(0, "PENDIENTE")], ["PENDIENTE"], "PENDIENTE"),
    ([event(0, "PENDIENTE"), event(1, "ERROR"), event(1, "PROCESADO"), event(0, "PENDIENTE")], ["PENDIENTE", "ERROR"], "ERROR"),
    ([event(1, "PROCESADO"), event(1, "ERROR")], [], None)])
def test_changes_of_a_file(events, states, last):
    whole, changes = ledger.next_changes(None, events)
    assert [c["estatus"] for c in changes] == states and whole["estatus"] == last
    assert [c["cambio"] for c in changes] == list(range(1, len(states) + 1))
    state, one_by_one = None, []
    for e in events:  # events in batches of their own change nothing
        state, c = ledger.next_changes(state, [e])
        one_by_one += c
    assert one_by_one == changes and state == whole


def test_restarted_ledger_goes_on(spark, tmp_path):
    s = new_store(spark)

    def publish(*rows):
        full = [(i, f"f{i}", "090852", "TIEMPOS_SOL", q, e, m, True, None, None, None, None, 0, datetime(2026, 1, i, 8)) for i, q, e, m in rows]
        from ventanilla.sources.fact_store import TABLES
        spark.createDataFrame(full, TABLES["bitacora"]).coalesce(1).write.mode("append").parquet(s.path(EVENTS))

    def run():
        ledger.start_ledger(s, s.path("_avance")).awaitTermination()
        return {r.id: (r.estatus, r.cambio, r.fecha_carga) for r in ledger.file_states(s).collect()}

    publish((1, 0, "PENDIENTE", None), (2, 0, "PENDIENTE", None), (3, 1, "ERROR", "x"))
    assert run() == {1: ("PENDIENTE", 1, datetime(2026, 1, 1, 8)), 2: ("PENDIENTE", 1, datetime(2026, 1, 2, 8))}
    publish((1, 1, "PROCESADO", None), (1, 0, "PENDIENTE", None))
    publish((3, 0, "PENDIENTE", None))
    assert run() == {1: ("PROCESADO", 2, datetime(2026, 1, 1, 8)), 2: ("PENDIENTE", 1, datetime(2026, 1, 2, 8)),
                     3: ("ERROR", 2, datetime(2026, 1, 3, 8))}
    publish((1, 1, "ERROR", "late"))
    assert run()[1] == ("PROCESADO", 2, datetime(2026, 1, 1, 8))
    assert ledger.state_changes(s).count() == 5
