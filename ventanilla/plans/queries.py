"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the stand-ins) in full and
runs the library's operators on them; nothing is capped or sampled. The
only ``limit`` calls are the features themselves (single-file pick, the
first 50 type values).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import compare, dashboard, export, metrics, quality, store
from ventanilla.operators.ranking import with_position
from ventanilla.plans import views as V
from ventanilla.sources import standins

Query = Callable[[SparkSession, str], DataFrame]

#: Arguments of the registered queries for one user, office and category.
USER, OFFICE, CATEGORY = "Supplier#000000004", "090853", "ENTREGA"
#: What the queries below read of the facts, beside the columns of the gate.
SOL_SUMMARY, CR_SUMMARY = ["archivo_id", "funcionario", "centesimas"], ["archivo_id", "terminal", "centesimas"]
SCOPED_COLUMNS = ["archivo_id", "row_no", "mac", "fecha", "funcionario", "centesimas"]


def clerk_ranking(spark, sf):
    """A7 + F12 + O2 per stored SOL file."""
    return dashboard.clerk_ranking(V.sol_facts(spark, sf), ["archivo_id"])


def clerk_day_ranking(spark, sf):
    """A7 + F12 + O2 per office and business date."""
    return dashboard.clerk_ranking(V.sol_facts(spark, sf), ["mac", "fecha"])


def file_summary(spark, sf):
    """A6 per stored SOL file."""
    return dashboard.file_summary(V.sol_facts(spark, sf))


def latest_file_per_office(spark, sf):
    """W1 / O1 over the file catalog: the pick of every (type, office)."""
    return dashboard.latest_file_per_office(standins.file_catalog(spark, sf)).drop("fecha_carga")


def latest_file(spark, sf):
    """P11 + O1: the SOL and the CR file a dashboard of office 090852 reads."""
    cat = standins.file_catalog(spark, sf)
    return (dashboard.latest_file(cat, dashboard.SOL_TYPE, mac="090852")
            .unionByName(dashboard.latest_file(cat, dashboard.CR_TYPE, mac="090852")).drop("fecha_carga"))


def cr_summary(spark, sf):
    """A8 per stored CR file."""
    return dashboard.cr_summary(V.cr_facts(spark, sf, CR_SUMMARY))


def cr_by_terminal(spark, sf):
    """A9 + O5 per stored CR file and terminal."""
    return with_position(dashboard.cr_by_terminal(V.cr_facts(spark, sf, CR_SUMMARY)), ["archivo_id"],
                         [F.col("entregas").desc(), F.col("terminal").asc()])


def cr_relative_outliers(spark, sf):
    """A10 + J4 per cleaned CR report."""
    return metrics.cr_relative_outliers(V.cr_clean(spark, sf))


def cr_file_metrics(spark, sf):
    """A10 + J4 for every CR file of the catalog: files without rows have the zero record."""
    files = dashboard.catalog_files(standins.file_catalog(spark, sf), dashboard.CR_TYPE)
    return metrics.cr_file_metrics(V.cr_clean(spark, sf), files)


def cr_terminal_metrics(spark, sf):
    """A11 + O7 per cleaned CR report and terminal (no terminal comes last of equals)."""
    return with_position(metrics.cr_terminal_metrics(V.cr_clean(spark, sf)), ["archivo_id"],
                         [F.col("entregas").desc(), F.col("terminal").asc_nulls_last()])


def dashboard_row(spark, sf):
    """P14 + J8 + F15: the dashboard row over all offices (no scope)."""
    sol, cr, catalog = V.facts_and_catalog(spark, sf, SOL_SUMMARY, CR_SUMMARY)
    return dashboard.dashboard(catalog, sol, cr)


def dashboard_by_office(spark, sf):
    """P14 for every office at once (W1 picks)."""
    sol, cr, catalog = V.facts_and_catalog(spark, sf, SOL_SUMMARY, CR_SUMMARY)
    return dashboard.dashboard_by_office(catalog, sol, cr)


def clerk_detail(spark, sf):
    """J5 + P12 + O4 + P19: detail rows of every clerk's latest office and day."""
    return dashboard.clerk_detail(V.sol_facts(spark, sf))


def clerk_latest_summary(spark, sf):
    """A12 + O3 for every clerk."""
    return dashboard.clerk_latest_summary(V.sol_facts(spark, sf))


def clerk_type_summary(spark, sf):
    """A13 + O5 for every clerk at the latest office and day."""
    return with_position(dashboard.clerk_type_summary(V.sol_facts(spark, sf)), ["funcionario"],
                         [F.col("total").desc(), F.col("tipo_tramite_categoria").asc()])


def terminal_share(spark, sf):
    """A2 + F14 per cleaned SOL report."""
    return metrics.terminal_share(V.sol_rows(spark, sf))


def category_counts(spark, sf):
    """A3 per cleaned SOL report."""
    return metrics.category_counts(V.sol_rows(spark, sf))


def clerk_metrics(spark, sf):
    """A4 + P10 + J4 + O6 per cleaned SOL report (equal counts by clerk)."""
    return with_position(metrics.clerk_metrics(V.sol_rows(spark, sf)), ["archivo_id"],
                         [F.col("total_registros").desc(), F.col("funcionario").asc()])


def clerk_category_metrics(spark, sf):
    """A5 + O6 per cleaned SOL report (equal counts by category)."""
    return with_position(metrics.clerk_category_metrics(V.sol_rows(spark, sf)), ["archivo_id"],
                         [F.col("funcionario").asc(), F.col("cantidad").desc(), F.col("tipo_tramite").asc_nulls_last()])


def global_threshold(spark, sf):
    """A1 per cleaned SOL report."""
    return metrics.global_threshold(V.sol_rows(spark, sf))


def sol_dedup(spark, sf):
    """Rows kept by first-row-wins dedup."""
    columns = ["archivo_id", "row_no", "folio", "funcionario", "terminal", "fecha"]
    return V.sol_kept(spark, sf, [*columns, "funcionario_txt"]).select(*columns)


def cr_dedup(spark, sf):
    """CR rows kept by first-row-wins dedup."""
    columns = ["archivo_id", "row_no", "solicitud", "terminal", "fecha_entrega"]
    return V.cr_kept(spark, sf, [*columns, "_p9"]).select(*columns)


def file_rollup(spark, sf):
    """Per received file the dates and period over all cleaned rows."""
    cols = ["archivo_id", "filas_limpias", "fecha_inicio", "fecha_fin", "fecha_operativa", "tipo_periodo"]
    sol = V.sol_stats(spark, sf).select(*cols, F.lit("TIEMPOS_SOL").alias("tipo"))
    cr = V.cr_stats(spark, sf).select(*cols, F.lit("TIEMPOS_CR").alias("tipo"))
    return sol.unionByName(cr)


def file_gate(spark, sf):
    """D3: the all-or-nothing gate of every SOL file."""
    return V.sol_stats(spark, sf).select("archivo_id", "filas_conservadas", "violaciones", "aceptado")


def ledger_latest(spark, sf):
    """D4 + W3: the latest state of every received file."""
    return V.ingest_catalog(spark, sf).drop("fecha_carga")


def quality_counts(spark, sf):
    """Q1: rule violations among the rows to be stored."""
    return quality.quality_counts(V.sol_kept(spark, sf, V.SOL_GATE), V.cr_kept(spark, sf, V.CR_GATE))


def orphans(spark, sf):
    """Facts without a catalog file, users without a role."""
    cat = standins.file_catalog(spark, sf)
    return (quality.orphans(V.sol_facts(spark, sf, ["archivo_id"]), "archivo_id", cat, "id", "tramites->archivos")
            .unionByName(quality.orphans(V.cr_facts(spark, sf, ["archivo_id"]), "archivo_id", cat, "id", "entregas->archivos"))
            .unionByName(quality.orphans(standins.users(spark, sf), "role_id", standins.roles(spark, sf), "id",
                                         "usuarios->roles")))


def unique_violations(spark, sf):
    """Q2: repeated values of unique keys."""
    return (quality.unique_violations(standins.roles(spark, sf), "nombre", "roles.nombre")
            .unionByName(quality.unique_violations(standins.users(spark, sf), "username", "usuarios.username"))
            .unionByName(quality.unique_violations(standins.file_catalog(spark, sf), "nombre_archivo",
                                                   "archivos.nombre_archivo")))


def _sol_clerk_report(spark, sf):
    """The per-clerk SOL report of the whole table taken as one report (S9 rows)."""
    rows = V.sol_rows(spark, sf)
    return export.export_rows(metrics.clerk_metrics(rows, []), metrics.global_threshold(rows, []), [])


def report_merge(spark, sf):
    """J2 + P15-P17 + O8: SOL per-clerk report merged with the CR per-clerk report."""
    sol = compare.sol_report_view(_sol_clerk_report(spark, sf))
    cr = compare.cr_report_view(standins.cr_clerk_report(spark, sf))
    return compare.merge_reports(sol, cr)


def merge_totals(spark, sf):
    """A14 + F15 over the merged table."""
    return compare.merge_totals(report_merge(spark, sf))


def export_rows(spark, sf):
    """P18 + F9 + F14: per-clerk report rows of every SOL report."""
    rows = V.sol_rows(spark, sf)
    return export.export_rows(metrics.clerk_metrics(rows), metrics.global_threshold(rows))


def user_roster(spark, sf):
    """Users with their role."""
    return dashboard.user_roster(standins.users(spark, sf), standins.roles(spark, sf))


def classify_names(spark, sf):
    """F1 + F2 over every catalog file name."""
    cat = standins.file_catalog(spark, sf)
    return cat.select("id", "nombre_archivo", C.office_of("nombre_archivo").alias("mac_detectado"),
                      C.report_type_of("nombre_archivo").alias("tipo_detectado"))


def category_of_text(spark, sf):
    """F4 over every raw type cell: (text, category, rows)."""
    raw = V.sol_report(spark, sf)
    t = F.col("`TIPO DE TRAMITE`")
    return (raw.groupBy(t.alias("tipo_texto"), C.category_of(t).alias("categoria"))
               .agg(F.count(F.lit(1)).alias("filas")))


def new_rows_only(spark, sf):
    """A full re-run of every report: only rows not stored yet pass."""
    keys = ["archivo_id", "folio", "funcionario", "terminal"]
    return (store.new_rows_only(V.sol_kept(spark, sf), V.sol_facts(spark, sf), keys)
            .select("archivo_id", "row_no", "folio", "funcionario", "terminal"))


def type_values_top50(spark, sf):
    """The first 50 distinct useful type values."""
    return metrics.type_values(V.sol_clean(spark, sf), "TIPO DE TRAMITE", 50)


def scoped_facts(spark, sf):
    """Rows of stored SOL facts each user may see."""
    return dashboard.scoped_counts(standins.users(spark, sf), V.sol_facts(spark, sf))


def scoped_rows(spark, sf):
    """The stored SOL rows that one user may see."""
    seen = dashboard.scoped_rows(V.sol_facts(spark, sf), standins.users(spark, sf), USER)
    return seen.select(*SCOPED_COLUMNS)


def scoped_latest_rows(spark, sf):
    """P13 + O1: the stored SOL rows of the latest file that one user may see."""
    sol, _, catalog = V.facts_and_catalog(spark, sf, SCOPED_COLUMNS, [])
    seen = dashboard.latest_scoped_rows(sol, catalog, standins.users(spark, sf), USER)
    return seen.select(*SCOPED_COLUMNS)


def clerk_detail_for(spark, sf):
    """P12 + P19: the detail rows of one office's clerks at their latest day there, of one category."""
    return dashboard.clerk_detail(V.sol_facts(spark, sf), mac=OFFICE, tipo=CATEGORY)


def upload_gate(spark, sf):
    """P20: accepted / rejected uploads with reason."""
    return quality.upload_gate(standins.uploads(spark, sf))


def tramite_time_join(spark, sf):
    """Applications joined with attention times (the reference's two tables)."""
    tr, ti = dashboard.split_facts(V.sol_facts(spark, sf))
    return dashboard.join_times(tr, ti).select("id", "archivo_id", "funcionario", "centesimas", "dentro_norma")


QUERIES: dict[str, Query] = {
    name: fn for name, fn in list(globals().items())
    if callable(fn) and getattr(fn, "__module__", None) == __name__ and not name.startswith("_")
}
