"""Cleaners, store semantics and metrics on hand-worked fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean, compare, dashboard, metrics, quality, store
from ventanilla.sources import reports
from ventanilla.sources.standins import SOL_HEADERS

from conftest import rows


def sol_report(spark, data):
    """data: list of dicts of header -> cell text, plus archivo_id / row_no."""
    cols = ["archivo_id", "nombre_archivo", "row_no"] + SOL_HEADERS
    out = []
    for i, d in enumerate(data):
        out.append(tuple([d.get("archivo_id", 1), d.get("nombre_archivo", "Rep_TiemAten_SOL_090852_1.xls"),
                          d.get("row_no", i)] + [d.get(h) for h in SOL_HEADERS]))
    schema = ", ".join(f"`{c}` {'bigint' if c in ('archivo_id', 'row_no') else 'string'}" for c in cols)
    return spark.createDataFrame(out, schema)


def test_p1_terminal_rule(spark):
    df = sol_report(spark, [{"TERMINAL": "CLIENTE 1", "FECHA DE TRAMITE": "03/03/2026"},
                            {"TERMINAL": None, "FECHA DE TRAMITE": "03/03/2026"},
                            {"TERMINAL": " terminal ", "FECHA DE TRAMITE": "03/03/2026"},
                            {"TERMINAL": "", "FECHA DE TRAMITE": "03/03/2026"}])
    assert sorted(r[0] for r in clean.clean_sol_report(df).select("row_no").collect()) == [0, 3]


def test_d1_first_row_wins_and_a15_dates_before_dedup(spark):
    df = sol_report(spark, [
        {"SOLICITUD": "A", "NOMBRE FUNCIONARIO": "X", "TERMINAL": "T1", "FECHA DE TRAMITE": "03/03/2026",
         "TIEMPO TOTAL DE ATENCIÓN": "0:10:00"},
        {"SOLICITUD": "A", "NOMBRE FUNCIONARIO": "X", "TERMINAL": "T1", "FECHA DE TRAMITE": "04/03/2026",
         "TIEMPO TOTAL DE ATENCIÓN": "0:20:00"}])
    r = clean.sol_rows(clean.clean_sol_report(df))
    by_key = store.ingest_by_key(r, store.sol_keys(), "fecha")
    kept = store.kept_rows(by_key)
    assert rows(kept, "row_no", "fecha") == [(0, dt.date(2026, 3, 3))]
    roll = store.file_stats(by_key, ["fecha"], office_col=None)
    assert rows(roll, "fecha_inicio", "fecha_fin", "tipo_periodo") == [(dt.date(2026, 3, 3), dt.date(2026, 3, 4), "SEMANAL")]


def test_d3_gate_rejects_whole_file(spark):
    df = sol_report(spark, [
        {"archivo_id": 1, "SOLICITUD": "A", "TERMINAL": "T", "FECHA DE TRAMITE": "03/03/2026"},
        {"archivo_id": 1, "SOLICITUD": "B", "TERMINAL": "T", "FECHA DE TRAMITE": "sin fecha"},
        {"archivo_id": 2, "SOLICITUD": "A", "TERMINAL": "T", "FECHA DE TRAMITE": "03/03/2026"},
        {"archivo_id": 2, "SOLICITUD": "A", "TERMINAL": "T", "FECHA DE TRAMITE": "x"}])  # duplicate: skipped first
    r = clean.sol_rows(clean.clean_sol_report(df))
    by_key = store.ingest_by_key(r, store.sol_keys(), "fecha")
    facts = store.accepted_rows(store.kept_rows(by_key), store.file_stats(by_key, ["fecha"], office_col=None))
    assert sorted(rows(facts, "archivo_id", "row_no")) == [(2, 2)]


def test_d3_gate_rejects_a_text_longer_than_its_column(spark):
    df = sol_report(spark, [
        {"archivo_id": 1, "nombre_archivo": "090852_SOL.xls", "SOLICITUD": "A" * 80, "TERMINAL": "T", "FECHA DE TRAMITE": "03/03/2026"},
        {"archivo_id": 2, "nombre_archivo": "090852_SOL.xls", "SOLICITUD": "A" * 50, "TERMINAL": "T", "FECHA DE TRAMITE": "03/03/2026"}])
    by_key = store.ingest_by_key(clean.sol_rows(clean.clean_sol_report(df)), store.sol_keys(), "fecha")
    got = rows(store.file_stats(by_key, ["fecha"], office_col=None, lengths=quality.SOL_LENGTHS), "archivo_id", "aceptado", "motivo_rechazo")
    assert sorted(got) == [(1, False, "value too long for type character varying(50)"), (2, True, None)]


def test_a15_periods(spark):
    df = sol_report(spark, [{"archivo_id": i, "SOLICITUD": str(n), "TERMINAL": "T", "FECHA DE TRAMITE": d}
                            for n, (i, d) in enumerate([(1, "03/03/2026"), (2, "03/03/2026"), (2, "04/03/2026"), (3, "x")])])
    by_key = store.ingest_by_key(clean.sol_rows(clean.clean_sol_report(df)), store.sol_keys(), "fecha")
    got = sorted(rows(store.file_stats(by_key, ["fecha"], office_col=None), "archivo_id", "tipo_periodo", "fecha_operativa"))
    assert got == [(1, "DIARIO", dt.date(2026, 3, 3)), (2, "SEMANAL", dt.date(2026, 3, 4)), (3, "DIARIO", None)]


def test_j1_row_numbers_restart_in_every_file(spark):
    facts = spark.createDataFrame([(1, 0, 100), (1, 1, 200), (2, 0, 300), (2, 1, 400)], "archivo_id bigint, row_no bigint, centesimas bigint")
    text = ["mac", "folio", "tipo_tramite", "categoria", "funcionario", "terminal", "domicilio_visible", "estatus_tramite"]
    facts = facts.withColumns({c: F.lit("x") for c in text} | {"fecha": F.lit(dt.date(2026, 3, 3)), "dentro_norma": F.lit(True),
                                                             "hora_inicio": F.lit(None).cast("timestamp_ntz"), "hora_fin": F.lit(None).cast("timestamp_ntz")})
    got = rows(dashboard.join_times(*dashboard.split_facts(facts)), "archivo_id", "id", "centesimas")
    assert sorted(got) == [(1, 0, 100), (1, 1, 200), (2, 0, 300), (2, 1, 400)]


def test_outlier_factor_is_exact():
    p, q = metrics._frac(1.234567)
    assert p * 1_000_000 == q * 1_234_567


def test_f6_huge_durations_are_null(spark):
    df = spark.createDataFrame([("9999999999:00:00",), ("999999999999 days 00:00:00",), ("1:00:00",)], "d string")
    assert [r[0] for r in df.select(C.duration_us("d")).collect()] == [None, None, 3_600_000_000]


def test_f16_only_plain_numbers_count(spark):
    df = spark.createDataFrame([("nan",), ("inf",), ("1d",), ("1e999",), (" 2.5 ",), ("-3",), (None,)], "t string")
    assert [r[0] for r in df.select(compare.to_number("t")).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5, -3.0, 0.0]


def test_s4_repeated_headers_never_collide(spark):
    cells = spark.createDataFrame([(1, "f", 1, ["X", "X", "X_2", "X"]), (1, "f", 2, ["", "", "", ""])],
                                  "archivo_id bigint, nombre_archivo string, row_no bigint, cells array<string>")
    names = reports.flatten_headers(cells, 1, True).first()["columnas"]
    assert len(set(names)) == 4 and names[0] == "X"


def test_j7_orphans_in_one_pass(spark):
    child = spark.createDataFrame([(1,), (2,), (None,), (1,)], "fk bigint")
    parent = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert rows(quality.orphans(child, "fk", parent, "id", "x"), "filas", "huerfanos") == [(4, 2)]


def test_a1_a4_relative_outliers(spark):
    df = sol_report(spark, [{"NOMBRE FUNCIONARIO": "X", "TERMINAL": "T", "TIEMPO TOTAL DE ATENCIÓN": t}
                            for t in ["0:10:00", "0:10:00", "0:40:00"]])
    r = clean.sol_rows(clean.clean_sol_report(df))
    g = metrics.global_threshold(r)
    assert rows(g, "promedio_tiempo", "umbral_atipico") == [("00:20:00", "00:30:00")]
    m = metrics.clerk_metrics(r)
    assert rows(m, "tramites_atipicos", "porcentaje_atipicos", "terminales") == [(1, 33.33, "T")]


def test_a10_zero_mean_has_no_outliers(spark):
    df = spark.createDataFrame([(1, 0, "T", "s"), (1, 0, "T", "s")],
                               "archivo_id bigint, centesimas bigint, terminal string, solicitud string")
    assert rows(metrics.cr_relative_outliers(df), "atipicos", "promedio_tiempo") == [(0, "00:00:00")]


def test_o1_pick_order(spark):
    cat = spark.createDataFrame([
        (1, "a", "090852", "TIEMPOS_SOL", "PROCESADO", True, dt.date(2026, 3, 9), None, "SEMANAL"),
        (2, "b", "090852", "TIEMPOS_SOL", "PROCESADO", True, dt.date(2026, 3, 2), None, "DIARIO"),
        (3, "c", "090852", "TIEMPOS_SOL", "PROCESADO", True, None, None, "DIARIO")],
        "id bigint, nombre_archivo string, mac string, tipo string, estatus string, activo boolean, "
        "fecha_operativa date, fecha_carga timestamp_ntz, tipo_periodo string")
    assert rows(dashboard.latest_file(cat, "TIEMPOS_SOL"), "id") == [(2,)]
    assert rows(dashboard.latest_file_per_office(cat), "id") == [(2,)]


def test_j2_null_safe_full_outer(spark):
    sol = spark.createDataFrame([("a", 1.0), (None, 2.0)], "funcionario string, sol_tramites double")
    cr = spark.createDataFrame([("a", 5.0), (None, 1.0), ("b", 3.0)], "funcionario string, cr_cantidad double")
    m = compare.merge_reports(sol, cr)
    assert sorted(rows(m, "funcionario", "tramites", "entregas"), key=str) == sorted(
        [("a", 1, 5), (None, 2, 1), ("b", 0, 3)], key=str)


def test_golden_terminal_shares(spark):
    counts = {"T1": 260, "T2": 256, "T3": 223, "T4": 209, "T5": 77, "T6": 74}
    data = [(1, t) for t, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(data, "archivo_id bigint, terminal_txt string")
    got = dict(rows(metrics.terminal_share(df), "terminal", "porcentaje"))
    assert got == {"T1": 23.66, "T2": 23.29, "T3": 20.29, "T4": 19.02, "T5": 7.01, "T6": 6.73}


def test_ranking_row_without_times(spark):
    df = spark.createDataFrame([(1, "X", None, None)] * 10,
                               "archivo_id bigint, funcionario string, terminal string, centesimas bigint")
    r = dashboard.clerk_ranking(df)
    assert rows(r, "promedio_tiempo", "desempeno", "terminales") == [("00:00:00", "Alto", "Sin terminal")]


def test_unknown_office_rejects_file(spark):
    df = sol_report(spark, [
        {"archivo_id": 1, "nombre_archivo": "Rep_TiemAten_SOL_1.xls", "SOLICITUD": "A", "TERMINAL": "T",
         "FECHA DE TRAMITE": "03/03/2026"},
        {"archivo_id": 2, "SOLICITUD": "A", "TERMINAL": "T", "FECHA DE TRAMITE": "03/03/2026"}])
    r = clean.sol_rows(clean.clean_sol_report(df))
    by_key = store.ingest_by_key(r, store.sol_keys(), "fecha")
    stats = store.file_stats(by_key, ["fecha"])
    assert sorted(rows(stats, "archivo_id", "aceptado")) == [(1, False), (2, True)]
    facts = store.accepted_rows(store.kept_rows(by_key), stats)
    assert rows(facts, "archivo_id") == [(2,)]


def test_p13_scope_fails_closed(spark):
    users = spark.createDataFrame([(1, "admin", 1, None), (2, "a", 3, "090852"), (3, "b", 3, None)],
                                  "id bigint, username string, role_id bigint, mac_asignado string")
    facts = spark.createDataFrame([("090852",), ("090852",), ("090853",)], "mac string")
    got = sorted(rows(dashboard.scoped_counts(users, facts), "id", "alcance", "filas_visibles"))
    assert got == [(1, "*", 3), (2, "090852", 2), (3, None, 0)]


def test_p11_optional_predicates(spark):
    cat = spark.createDataFrame([
        (1, "a", "090852", "TIEMPOS_SOL", "PROCESADO", True, dt.date(2026, 3, 2), None, "DIARIO"),
        (2, "b", "090853", "TIEMPOS_SOL", "PROCESADO", True, dt.date(2026, 3, 3), None, "DIARIO"),
        (3, "c", "090853", "TIEMPOS_SOL", "ERROR", True, dt.date(2026, 3, 4), None, "DIARIO"),
        (4, "d", "090853", "TIEMPOS_SOL", "PROCESADO", False, dt.date(2026, 3, 5), None, "DIARIO")],
        "id bigint, nombre_archivo string, mac string, tipo string, estatus string, activo boolean, "
        "fecha_operativa date, fecha_carga timestamp_ntz, tipo_periodo string")
    assert rows(dashboard.latest_file(cat, "TIEMPOS_SOL"), "id") == [(2,)]
    assert rows(dashboard.latest_file(cat, "TIEMPOS_SOL", mac="090852"), "id") == [(1,)]
    assert rows(dashboard.latest_file(cat, "TIEMPOS_SOL", fecha="2026-03-02"), "id") == [(1,)]
    assert dashboard.latest_file(cat, "TIEMPOS_CR").count() == 0
