"""Queries over the fact store: reports are ingested once, everything shown is read from the store."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.operators import clean, intake, rollups
from ventanilla.plans import views as V
from ventanilla.plans.file_queries import SOL_TITLE, _mixed_landing
from ventanilla.session import scratch_path, staged
from ventanilla.sources import reports, standins
from ventanilla.sources.fact_store import FactStore
from ventanilla.streaming.intake import start_intake
from ventanilla.streaming.ledger import file_states, start_ledger


def new_store(spark: SparkSession) -> FactStore:
    return FactStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex[:12]}"))


def stored(spark: SparkSession, sf: str) -> FactStore:
    """A store with all reports of both kinds, gated by their uploads, ingested as one batch."""
    target = new_store(spark)
    uploads = staged(standins.report_uploads(spark, sf), "subidas")
    received = uploads.select("archivo_id", "nombre_archivo", V.C.office_of("nombre_archivo").alias("mac"),
                              V.C.report_type_of("nombre_archivo").alias("tipo"), "fecha_carga")
    intake.ingest_reports(target, 0, received, V.sol_rows(spark, sf), clean.cr_fact_projection(V.cr_clean(spark, sf)), uploads)
    return target


def store_then_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + D3 + D4 + P20 + W1 + P13 + P14: ingest, then every user's dashboard from the stored roll-ups and catalog."""
    s = stored(spark, sf)
    by_scope = rollups.dashboards_by_scope(intake.catalog(s), s.table("resumen_sol"), s.table("resumen_cr"))
    return rollups.user_dashboards(standins.users(spark, sf), by_scope)


def store_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """D4 + W3: the stored catalog with load times."""
    return (intake.catalog(stored(spark, sf)).withColumn("fecha_carga", F.date_format("fecha_carga", "yyyy-MM-dd HH:mm:ss")))


def _streamed(spark: SparkSession, sf: str) -> FactStore:
    target = new_store(spark)
    folder = _mixed_landing(spark, sf, one_file_per_report=True)
    start_intake(target, os.path.join(folder, "*", "*.txt"), target.path("_avance"), staged(standins.report_uploads(spark, sf), "subidas")).awaitTermination()
    return target


def arrival_states(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + P20 + Q3: stream a landing folder of both kinds with faulty files; every received file's last state."""
    return intake.destinations(_streamed(spark, sf))


def ledger_states(spark: SparkSession, sf: str) -> DataFrame:
    """D4 + W3 + T1: the same landing folder, the ledger kept by the state machine over the published events."""
    target = _streamed(spark, sf)
    start_ledger(target, target.path("_avance_bitacora")).awaitTermination()
    return file_states(target).select("nombre_archivo", "mac", "tipo", "estatus", F.coalesce("mensaje_error", F.lit("")).alias("mensaje_error"), "cambio",
                                      "tipo_periodo", "registros_insertados", F.date_format("fecha_carga", "yyyy-MM-dd HH:mm:ss").alias("fecha_carga"))


def reupload_states(spark: SparkSession, sf: str) -> DataFrame:
    """D6 + T1: every third SOL report is uploaded again under a new name; refused while the option is on."""
    target = new_store(spark)
    folder = scratch_path(spark, f"landing-{uuid.uuid4().hex[:12]}")
    rows = staged(standins.sol_report_rows(spark, sf), "renglones")
    again = rows.where("archivo_id % 3 = 0").withColumn("nombre_archivo", F.concat(F.lit("copia_"), "nombre_archivo"))
    lines = reports.export_lines(rows.unionByName(again), standins.SOL_HEADERS, reports.SOL_LAYOUT["header_row"], SOL_TITLE)
    reports.write_exports(lines, folder, one_file_per_report=True)
    uploads = staged(standins.report_uploads(spark, sf), "subidas").withColumn("role_id", F.lit(1)).withColumn("tipo_esperado", F.lit(None).cast("string"))
    copies = uploads.where("archivo_id % 3 = 0").select(
        "archivo_id", F.concat(F.lit("copia_"), "nombre_archivo").alias("nombre_archivo"), "role_id", "mac_usuario", "tipo_esperado",
        (F.col("fecha_carga") + F.expr("interval 1 day")).alias("fecha_carga"))
    start_intake(target, os.path.join(folder, "*", "*.txt"), target.path("_avance"), uploads.unionByName(copies), refuse_repeats=True).awaitTermination()
    stored_rows = target.table("tramites").groupBy("nombre_archivo").agg(F.count(F.lit(1)).alias("filas"))
    return (intake.destinations(target).join(stored_rows, "nombre_archivo", "left")
            .select("nombre_archivo", "estatus", "motivo", F.coalesce("filas", F.lit(0)).cast("bigint").alias("filas")))


STORE_QUERIES = {"store_then_dashboard": store_then_dashboard, "store_catalog": store_catalog, "arrival_states": arrival_states,
                 "ledger_states": ledger_states, "reupload_states": reupload_states}
