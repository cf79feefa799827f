"""P13 rows by user, A10's zero record, S7's empty report."""

import datetime

from pyspark.sql import functions as F

from ventanilla.operators import dashboard, metrics
from ventanilla.sources import reports

DAY = datetime.date(2025, 3, 1)


def _users(spark):
    rows = [("jefa", 1, None), ("una", 2, "090852"), ("sin", 2, None), ("otra", 3, "090853")]
    return spark.createDataFrame(rows, "username string, role_id bigint, mac_asignado string")


def _facts(spark):
    rows = [(1, 1, "090852"), (1, 2, "090852"), (2, 1, "090853"), (3, 1, None), (4, 1, "090852")]
    return spark.createDataFrame(rows, "archivo_id bigint, row_no bigint, mac string")


def _seen(df):
    return sorted((r.archivo_id, r.row_no) for r in df.collect())


def test_scoped_rows_of_each_kind_of_user(spark):
    facts, users = _facts(spark), _users(spark)
    assert len(_seen(dashboard.scoped_rows(facts, users, "jefa"))) == 5  # also rows without an office
    assert _seen(dashboard.scoped_rows(facts, users, "una")) == [(1, 1), (1, 2), (4, 1)]
    assert _seen(dashboard.scoped_rows(facts, users, "otra")) == [(2, 1)]
    assert _seen(dashboard.scoped_rows(facts, users, "sin")) == []
    assert _seen(dashboard.scoped_rows(facts, users, "nadie")) == []


def test_scope_is_a_filter_without_a_join(spark):
    plan = dashboard.scoped_rows(_facts(spark), _users(spark), "una")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_latest_scoped_rows_read_the_pick_of_the_scope(spark):
    files = spark.createDataFrame(
        [(i, f"f{i}", mac, "TIEMPOS_SOL", "PROCESADO", True, DAY + datetime.timedelta(i), None, "DIARIO")
         for i, mac in ((1, "090852"), (2, "090853"))],
        "id bigint, nombre_archivo string, mac string, tipo string, estatus string, activo boolean,"
        "fecha_operativa date, fecha_carga timestamp_ntz, tipo_periodo string")
    facts, users = _facts(spark), _users(spark)
    got = {u: _seen(dashboard.latest_scoped_rows(facts, files, users, u)) for u in ("jefa", "una", "otra", "sin")}
    assert got == {"jefa": [(2, 1)], "una": [(1, 1), (1, 2)], "otra": [(2, 1)], "sin": []}


def test_detail_of_a_category_counts_rows_without_one_as_no_data(spark):
    t = datetime.datetime(2025, 3, 1, 9)
    rows = [("ana", "090852", DAY, n, cat, t, t, 100) for n, cat in ((1, None), (2, "ENTREGA"), (3, "Sin dato"))]
    facts = spark.createDataFrame(rows, "funcionario string, mac string, fecha date, row_no bigint, categoria string,"
                                        "hora_inicio timestamp_ntz, hora_fin timestamp_ntz, centesimas bigint")
    for c in ("folio", "tipo_tramite", "terminal", "domicilio_visible", "estatus_tramite"):
        facts = facts.withColumn(c, F.lit(None).cast("string"))
    of = lambda tipo: sorted(r.row_no for r in dashboard.clerk_detail(facts, nombre="ana", tipo=tipo).collect())
    assert (of("Sin dato"), of("ENTREGA"), of(None), of("OTRO")) == ([1, 3], [2], [1, 2, 3], [])


def test_cr_file_without_rows_has_the_zero_record(spark):
    rows = spark.createDataFrame([(7, 200), (7, 400)], "archivo_id bigint, centesimas bigint")
    files = spark.createDataFrame([(7,), (8,), (8,)], "archivo_id bigint")
    got = {r.archivo_id: tuple(r)[1:] for r in metrics.cr_file_metrics(rows, files).collect()}
    assert got[8] == (0, "00:00:00", "00:00:00", "00:00:00", 0) and got[7][0] == 2 and len(got) == 2
    assert metrics.cr_file_metrics(rows.limit(0), files.limit(0)).count() == 0


def test_missing_csv_is_an_empty_report(spark, tmp_path):
    df = reports.read_csv_report(spark, str(tmp_path / "no_hay.csv"))
    assert df.columns == [] and df.count() == 0
