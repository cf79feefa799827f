"""Report files as they arrive: the columns each file really has, its rows, and error records.

The headers differ from file to file, so every rule that asks whether a
report has a column (P1, P4, F3) is decided per file from a small table
``archivo_id, _columnas`` that is joined to the rows. ``apart`` writes such
tables first (see ``reports.report_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean
from ventanilla.session import staged
from ventanilla.sources import reports
from ventanilla.sources.standins import SOL_HEADERS

TYPE_HEADER = C.TYPE_COLUMN_CANDIDATES[0]
SOL_NAMES = SOL_HEADERS + [c for c in C.TYPE_COLUMN_CANDIDATES if c not in SOL_HEADERS]
CR_NAMES = list(clean.CR_COLUMN_MAP)
CR_KEY_HEADERS = [h for h, name in clean.CR_COLUMN_MAP.items() if name in clean.CR_REQUIRED]
# Fixed texts of the error records.
NO_LINES, NO_NUMBER, NO_HEADER, NO_DATA_ROWS = ("Archivo vacío", "Renglones sin número de fila", "Sin renglones de encabezado",
                                                "Sin renglones de datos")
MISSING_KEYS = "Faltan columnas clave en CR: "


def received_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every report under ``folder``, files without lines included (metadata only)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    named = F.regexp_extract("path", r"reporte=([^/]+)/", 1)
    name = F.when(named != "", named).otherwise(F.element_at(F.split("path", "/"), -1))
    return (files.groupBy(name.alias("nombre_archivo")).agg(F.max("modificationTime").alias("fecha_carga"))
            .select(F.xxhash64("nombre_archivo").alias("archivo_id"), "nombre_archivo", C.office_of("nombre_archivo").alias("mac"),
                    C.report_type_of("nombre_archivo").alias("tipo"), "fecha_carga"))


def of_kind(cells: DataFrame, kind: str) -> DataFrame:
    """F1 at arrival: the cells of the files whose name says this kind of report."""
    return cells.where((F.col("tipo") if "tipo" in cells.columns else C.report_type_of("nombre_archivo")) == kind)


def file_columns(raw: DataFrame, names: list[str]) -> DataFrame:
    """Per file the wanted columns with any cell (a column empty throughout counts as absent)."""
    held = [F.when(F.bool_or(F.col(f"`{n}`").isNotNull()), F.lit(n)) for n in names]
    return raw.groupBy("archivo_id").agg(F.array_compact(F.array(*held)).alias("_columnas"))


def _has(name: str) -> Column:
    return F.array_contains("_columnas", name)


def sol_rows_of_files(cells: DataFrame, apart: bool = False) -> DataFrame:
    """S2, P1, F3, P8 for the SOL files among ``cells``: typed rows, header rules decided per file."""
    layout = reports.SOL_LAYOUT
    raw = reports.report_rows(of_kind(cells, "TIEMPOS_SOL"), SOL_NAMES, layout["header_row"], layout["strip_header"],
                              any_case=C.TYPE_COLUMN_CANDIDATES, apart=apart)
    held = file_columns(raw, SOL_NAMES)
    rows = raw.join(staged(held, "columnas") if apart else held, "archivo_id")
    kind = F.lit(None).cast("string")
    for name in reversed(C.TYPE_COLUMN_CANDIDATES):
        kind = F.when(_has(name), F.col(f"`{name}`")).otherwise(kind)
    others = [c for c in C.TYPE_COLUMN_CANDIDATES if c != TYPE_HEADER]
    kept = clean.clean_sol_report(rows.withColumn(TYPE_HEADER, kind).drop(*others), _has(clean.HEADER_TERMINAL), ("_columnas",))
    return clean.sol_rows(kept)


def cr_rows_of_files(cells: DataFrame, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3, P2-P7 for the CR files among ``cells``: cleaned rows of complete files, and ``archivo_id, faltan``.

    A file without one of the key columns gives no rows, only its list.
    """
    layout = reports.CR_LAYOUT
    raw = reports.report_rows(of_kind(cells, "TIEMPOS_CR"), CR_NAMES, layout["header_row"], layout["strip_header"], layout["drop_empty_rows"],
                              apart=apart)
    held = file_columns(raw, CR_NAMES)
    names = F.array(*[F.lit(clean.CR_COLUMN_MAP[h]) for h in CR_KEY_HEADERS])
    have = F.array_compact(F.array(*[F.when(_has(h), F.lit(clean.CR_COLUMN_MAP[h])) for h in CR_KEY_HEADERS]))
    lacking = held.select("archivo_id", F.array_except(names, have).alias("faltan"))
    if apart:
        lacking = staged(lacking, "faltan")
    whole = raw.join(lacking.where(F.size("faltan") == 0).select("archivo_id"), "archivo_id", "left_semi")
    return clean.clean_cr_report(whole), lacking


def file_errors(received: DataFrame, cells: DataFrame) -> DataFrame:
    """One record per received file that cannot be ingested: ``nombre_archivo, mac, tipo, motivo``."""
    head = F.when(F.col("tipo") == "TIEMPOS_CR", reports.CR_LAYOUT["header_row"]).otherwise(reports.SOL_LAYOUT["header_row"])
    n = F.col("row_no")
    state = (cells.withColumn("tipo", C.report_type_of("nombre_archivo")).groupBy("archivo_id").agg(
        F.count(F.lit(1)).alias("_lineas"), F.count_if(n.isNull()).alias("_sin_numero"),
        F.count_if((n == head) | (n == head + 1)).alias("_encabezados"), F.count_if(n > head + 1).alias("_datos")))
    lacking = cr_rows_of_files(cells)[1]
    j = received.join(state, "archivo_id", "left").join(lacking, "archivo_id", "left")
    reason = (F.when(F.coalesce("_lineas", F.lit(0)) == 0, F.lit(NO_LINES))
               .when(F.col("_sin_numero") > 0, F.lit(NO_NUMBER))
               .when(F.col("_encabezados") == 0, F.lit(NO_HEADER))
               .when(F.col("_datos") == 0, F.lit(NO_DATA_ROWS))
               .when(F.size("faltan") > 0, F.concat(F.lit(MISSING_KEYS), F.array_join("faltan", ", "))))
    return j.select("nombre_archivo", "mac", "tipo", reason.alias("motivo")).where("motivo is not null")
