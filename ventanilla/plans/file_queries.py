"""Queries that write and read files: batch ingest of a landing folder of
report exports or workbooks (S1-S5, S4), the streaming ingest (T1, T2) and the
report files (S9, S11).

The landing folder is generated by Spark from the stand-in report rows
(that only builds the input files); everything after the write -- reading,
header flattening, cleaning, dedup, gate, writing facts -- is the library's
job. Folders live under the shared checkpoint folder of the session.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean, export, metrics
from ventanilla.plans import views as V
from ventanilla.session import scratch_path, staged
from ventanilla.sources import arrivals, named_files, reports, sheets, standins
from ventanilla.streaming import ingest

SOL_TITLE = "REPORTE DE TIEMPOS DE ATENCION"
FILE_NAME = ("archivo_id", "nombre_archivo")
CR_TITLE = "REPORTE DE ENTREGA DE CREDENCIALES"


def _landing(spark: SparkSession, sf: str, one_file_per_report: bool) -> str:
    folder = scratch_path(spark, f"landing-{uuid.uuid4().hex[:12]}")
    rows = staged(standins.sol_report_rows(spark, sf), "renglones")
    lines = reports.export_lines(rows, standins.SOL_HEADERS, reports.SOL_LAYOUT["header_row"], SOL_TITLE)
    reports.write_exports(lines, folder, one_file_per_report)
    return folder


def report_file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + S4 + P1 + P8 from a landing folder of SOL exports: typed rows of every report."""
    folder = _landing(spark, sf, one_file_per_report=False)
    cells = reports.read_cells(spark, folder, by_directory=True)
    raw = reports.report_rows(cells, standins.SOL_HEADERS, reports.SOL_LAYOUT["header_row"],
                              reports.SOL_LAYOUT["strip_header"])
    rows = clean.sol_rows(clean.clean_sol_report(raw))
    return rows.select("nombre_archivo", "mac", "row_no", "fecha", "folio", "categoria", "funcionario",
                       "terminal", "centesimas")


def _streamed(spark: SparkSession, folder: str) -> str:
    out = scratch_path(spark, f"stream-out-{uuid.uuid4().hex[:12]}")
    q = ingest.start_ingest(spark, os.path.join(folder, "*", "*.txt"), out, os.path.join(out, "_checkpoint"))
    q.awaitTermination()
    return out


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + T2: stream a landing folder of SOL files to completion; the stored facts."""
    facts = ingest.stored(spark, _streamed(spark, _landing(spark, sf, one_file_per_report=True)), "facts")
    return facts.select("nombre_archivo", "mac", "row_no", "fecha", "folio", "funcionario", "terminal",
                        "centesimas")


def stream_cr_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + T2: stream a landing folder of CR files to completion; the stored facts."""
    folder = scratch_path(spark, f"landing-{uuid.uuid4().hex[:12]}")
    lines = reports.export_lines(staged(standins.cr_report_rows(spark, sf), "renglones"), standins.CR_HEADERS, reports.CR_LAYOUT["header_row"], CR_TITLE)
    reports.write_exports(lines, folder, one_file_per_report=True)
    facts = ingest.stored(spark, _streamed(spark, folder), "facts_cr")
    return facts.select("nombre_archivo", "mac", "row_no", "fecha_entrega", "solicitud", "terminal", "centesimas")


def _mixed_landing(spark: SparkSession, sf: str, one_file_per_report: bool = False) -> str:
    """A landing folder of both kinds in which some files deviate: by the last digit of the file id,
    SOL files head the type column ``TRAMITE`` (3), lack TERMINAL (5) or the header rows (7); CR files
    lack the duration (4) or hold no data rows (6)."""
    sol, cr = staged(standins.sol_report_rows(spark, sf), "renglones"), staged(standins.cr_report_rows(spark, sf), "renglones")
    digit = F.col("archivo_id") % 10
    sol_head, cr_head = reports.SOL_LAYOUT["header_row"], reports.CR_LAYOUT["header_row"]
    renamed = ["TRAMITE" if h == arrivals.TYPE_HEADER else h for h in standins.SOL_HEADERS]
    headless = reports.export_lines(sol.where(digit == 7), standins.SOL_HEADERS, sol_head, SOL_TITLE)
    parts = [
        reports.export_lines(sol.where(~digit.isin(3, 5, 7)), standins.SOL_HEADERS, sol_head, SOL_TITLE),
        reports.export_lines(sol.where(digit == 3).withColumnRenamed(arrivals.TYPE_HEADER, "TRAMITE"), renamed, sol_head, SOL_TITLE),
        reports.export_lines(sol.where(digit == 5), [h for h in standins.SOL_HEADERS if h != "TERMINAL"], sol_head, SOL_TITLE),
        headless.where(~F.col("row_no").isin(sol_head, sol_head + 1)),
        reports.export_lines(cr.where(~digit.isin(4, 6)), standins.CR_HEADERS, cr_head, CR_TITLE),
        reports.export_lines(cr.where(digit == 4), [h for h in standins.CR_HEADERS if h != "TIEMPO TOTAL DE ATENCIÓN"], cr_head, CR_TITLE),
        reports.export_lines(cr.where(digit == 6), standins.CR_HEADERS, cr_head, CR_TITLE).where(F.col("row_no") <= cr_head + 1)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    folder = scratch_path(spark, f"landing-{uuid.uuid4().hex[:12]}")
    reports.write_exports(lines, folder, one_file_per_report)
    return folder


def sol_file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S2, P1, F3, P8 from a landing folder of both kinds: rows of the SOL files, header rules per file."""
    cells = reports.stored_cells(reports.read_cells(spark, _mixed_landing(spark, sf), by_directory=True))
    return arrivals.sol_rows_of_files(cells).select("nombre_archivo", "mac", "row_no", "fecha", "folio", "categoria", "funcionario",
                                                    "terminal", "centesimas")


def cr_file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S3, P2-P7 from a landing folder of both kinds: cleaned rows of the complete CR files."""
    cells = reports.stored_cells(reports.read_cells(spark, _mixed_landing(spark, sf), by_directory=True))
    return arrivals.cr_rows_of_files(cells)[0].select("nombre_archivo", "mac", "row_no", "fecha_entrega", "solicitud", "terminal", "centesimas")


def file_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Error records of every received file of a landing folder of both kinds that cannot be ingested."""
    folder = _mixed_landing(spark, sf)
    return arrivals.file_errors(arrivals.received_files(spark, folder), reports.stored_cells(reports.read_cells(spark, folder, by_directory=True)))


def _workbooks(spark: SparkSession, rows: DataFrame, headers: list[str], header_row: int, title: str) -> str:
    """A landing folder with one workbook per report."""
    folder = scratch_path(spark, f"libros-{uuid.uuid4().hex[:12]}")
    sheet = reports.sheet_rows(rows, headers, header_row, title).select(
        F.lit("recibidos").alias("tipo"), C.base_name("reporte").alias("reporte"), "row_no", "cells")
    named_files.write_named(sheet, folder, ["row_no"], named_files.ReportSheet)
    return folder


def _sol_workbooks(spark: SparkSession, sf: str) -> str:
    return _workbooks(spark, standins.sol_report_rows(spark, sf), standins.SOL_HEADERS, reports.SOL_LAYOUT["header_row"], SOL_TITLE)


def _cells_table(spark: SparkSession) -> str:
    return scratch_path(spark, f"celdas-{uuid.uuid4().hex[:12]}")


def _stored_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the SOL workbooks, each file parsed once into a table: headers and rows are read apart."""
    cells, out = sheets.read_sheets(sheets.sheet_files(spark, _sol_workbooks(spark, sf))), _cells_table(spark)
    cells.write.parquet(out)
    return sheets.whole_files(spark.read.schema(cells.schema).parquet(out))


def sheet_file_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + S4 + P1 + P8 from a landing folder of SOL workbooks: typed rows of every report."""
    cells = _stored_cells(spark, sf)
    return arrivals.sol_rows_of_files(cells, apart=True).select("nombre_archivo", "mac", "row_no", "fecha", "folio", "categoria", "funcionario",
                                                    "terminal", "centesimas")


def sheet_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and widest row of every workbook of a landing folder."""
    cells = _stored_cells(spark, sf)
    return reports.probe(cells)[0].select("nombre_archivo", "filas", "columnas")


def sheet_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """T1 + S3: stream a landing folder of CR workbooks into a table of cells; cleaned rows of the complete files."""
    folder = _workbooks(spark, standins.cr_report_rows(spark, sf), standins.CR_HEADERS, reports.CR_LAYOUT["header_row"], CR_TITLE)
    out = _cells_table(spark)
    stream = sheets.read_sheets(sheets.sheet_file_stream(spark, folder))
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(out, "_avance"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = arrivals.cr_rows_of_files(sheets.whole_files(spark.read.schema(stream.schema).parquet(out)), apart=True)[0]
    return rows.select("nombre_archivo", "mac", "row_no", "fecha_entrega", "solicitud", "terminal", "centesimas")


def _written(spark: SparkSession, rows: DataFrame, tipo: str, report: F.Column, order: list) -> DataFrame:
    """Writes one CSV file per report of ``rows`` and reads all files again, with their names as ``archivo``; empty cells are null."""
    folder = scratch_path(spark, f"reportes-{uuid.uuid4().hex[:12]}")
    own = rows.drop(*FILE_NAME)
    named_files.write_named(rows.select(F.lit(tipo).alias("tipo"), report.alias("reporte"), *own.columns), folder, order)
    back = (spark.read.schema(own.schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", False)
            .csv(os.path.join(folder, tipo)))
    return back.select(F.col("_metadata.file_name").alias("archivo"), *own.columns)


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + F18 + P18: the clerks' report of every SOL file as one named CSV file, read back with its name."""
    rows = V.sol_rows(spark, sf)
    out = export.export_rows(metrics.clerk_metrics(rows, FILE_NAME), metrics.global_threshold(rows, FILE_NAME), FILE_NAME)
    # P18 has empty texts and no null ones
    return _written(spark, out, "tiempos_sol", export.report_name("nombre_archivo"), ["funcionario"]).fillna("")


def terminal_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and share per terminal of every SOL file as one named CSV file, the busiest first; read back with its name."""
    shares = metrics.terminal_share(V.sol_rows(spark, sf), FILE_NAME)
    out = export.terminal_csv_rows(shares, FILE_NAME)
    name = F.concat(C.base_name("nombre_archivo"), F.lit("_metricas"))
    return _written(spark, out, "terminales", name, [F.desc("registros"), "terminal"])


FILE_QUERIES = {"sol_file_ingest": sol_file_ingest, "cr_file_ingest": cr_file_ingest, "file_errors": file_errors,
                "report_file_ingest": report_file_ingest, "stream_ingest": stream_ingest,
                "stream_cr_ingest": stream_cr_ingest, "sheet_file_ingest": sheet_file_ingest, "sheet_probe": sheet_probe,
                "sheet_stream_ingest": sheet_stream_ingest, "report_files": report_files, "terminal_files": terminal_files}
