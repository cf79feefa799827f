"""Per-clerk report rows and CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators.common import attach

REPORT_SUFFIX = "_reporte_funcionarios"
EXPORT_COLUMNS = ["funcionario", "tramites_reales", "entregas", "total_registros", "porcentaje_tramites",
                  "promedio_general", "promedio_tramites", "promedio_entregas", "tiempo_minimo",
                  "tiempo_maximo", "tramites_atipicos", "porcentaje_atipicos", "terminales"]


def export_rows(clerks: DataFrame, group_totals: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """One report row per clerk: share of the group's rows as 'x%',
    durations as HH:MM:SS (F9: days dropped, fraction cut; none -> '')."""
    j = attach(clerks, group_totals.select(*keys, F.col("total_registros").alias("_grp_total")), keys)
    pct = C.percent_hundredths(F.col("tramites_reales"), F.col("_grp_total"))
    pct_txt = F.when(F.col("_grp_total") > 0, C.py_number_text(pct)).otherwise(F.lit("0"))
    return j.select(
        *keys, "funcionario", "tramites_reales", "entregas", "total_registros",
        F.concat(pct_txt, F.lit("%")).alias("porcentaje_tramites"),
        C.timedelta_hms("promedio_general_us").alias("promedio_general"),
        C.timedelta_hms("promedio_tramites_us").alias("promedio_tramites"),
        C.timedelta_hms("promedio_entregas_us").alias("promedio_entregas"),
        C.timedelta_hms("tiempo_minimo_us").alias("tiempo_minimo"),
        C.timedelta_hms("tiempo_maximo_us").alias("tiempo_maximo"),
        "tramites_atipicos", "porcentaje_atipicos", "terminales")


def write_reports(rows: DataFrame, out_dir: str, tipo_col: str = "tipo", name_col: str = "reporte") -> None:
    """One CSV folder per (type, report), written by the executors.
    A retried write replaces exactly the partitions it produced (dynamic overwrite)."""
    (rows.write.mode("overwrite").option("header", True)
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(tipo_col, name_col).csv(out_dir))


def report_name(file_name_col) -> F.Column:
    """'<base name>_reporte_funcionarios'."""
    return F.concat(C.base_name(file_name_col), F.lit(REPORT_SUFFIX))


def terminal_csv_rows(shares: DataFrame, keys=()) -> DataFrame:
    """Terminal, registros, porcentaje (the sample result layout), behind the group's keys."""
    return shares.select(*keys, "terminal", "registros", "porcentaje")
