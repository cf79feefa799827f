"""Lazy views: stand-in reports -> cleaned rows -> kept rows -> facts -> ledger.

Each function returns a lazy DataFrame over the given tables; a registered
query composes them and Catalyst plans the whole chain at once (column
pruning reaches the parquet scan, filters are pushed down).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean, quality, store
from ventanilla.session import staged
from ventanilla.sources import standins


def sol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.sol_report_rows(spark, sf_dir)


def sol_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_sol_report(sol_report(spark, sf_dir))


def sol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.sol_rows(sol_clean(spark, sf_dir))


#: What the gate and the roll-up look at; the kept row carries only these where no other column is asked for.
SOL_GATE = ["archivo_id", "row_no", "mac", "fecha", "centesimas", "funcionario_txt", *quality.SOL_LENGTHS]
CR_GATE = ["archivo_id", "row_no", "mac", "fecha_entrega", "centesimas", "_p9", *quality.CR_LENGTHS]


def sol_by_key(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """D1 + A15 + Q3 in one aggregation per dedup key; ``columns`` of the kept row (all by default)."""
    rows = sol_rows(spark, sf_dir)
    if columns:
        rows = rows.select(*columns)
    t = F.col("funcionario_txt")
    clerk_ok = (F.length(t) > 0) & (F.upper(t) != clean.HEADER_CLERK) & (F.lower(t) != "nan")
    return store.ingest_by_key(rows, store.sol_keys(), "fecha", clerk_ok=clerk_ok)


def sol_kept(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return store.kept_rows(sol_by_key(spark, sf_dir, columns))


def sol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_stats(sol_by_key(spark, sf_dir, SOL_GATE), ["fecha"], lengths=quality.SOL_LENGTHS)


def sol_ingest(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The by-key table of all SOL reports and their file statistics, each computed once and written."""
    by_key = staged(sol_by_key(spark, sf_dir, _with_gate(columns, SOL_GATE)), "sol-claves")
    return by_key, staged(store.file_stats(by_key, ["fecha"], lengths=quality.SOL_LENGTHS), "sol-archivos")


def sol_facts(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Stored SOL facts: kept rows of files the gate accepts; ``columns`` (all by default) beside those of the gate."""
    by_key, stats = sol_ingest(spark, sf_dir, columns)
    return store.accepted_rows(store.kept_rows(by_key), stats)


def cr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.cr_report_rows(spark, sf_dir)


def cr_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_cr_report(cr_report(spark, sf_dir))


def cr_by_key(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """D2 (over rows P9 keeps) + A15 (over all cleaned rows) in one aggregation; ``columns`` of the kept row (all by default)."""
    proj = clean.cr_fact_projection(cr_clean(spark, sf_dir))
    if columns:
        proj = proj.select(*columns)
    return store.ingest_by_key(proj, store.cr_keys(), "fecha_entrega", valid=F.col("_p9"))


def cr_kept(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return store.kept_rows(cr_by_key(spark, sf_dir, columns)).drop("_p9")


def cr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_stats(cr_by_key(spark, sf_dir, CR_GATE), ["fecha_entrega"], lengths=quality.CR_LENGTHS)


def cr_ingest(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The by-key table of all CR reports and their file statistics, each computed once and written."""
    by_key = staged(cr_by_key(spark, sf_dir, _with_gate(columns, CR_GATE)), "cr-claves")
    return by_key, staged(store.file_stats(by_key, ["fecha_entrega"], lengths=quality.CR_LENGTHS), "cr-archivos")


def cr_facts(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    by_key, stats = cr_ingest(spark, sf_dir, columns)
    return store.accepted_rows(store.kept_rows(by_key).drop("_p9"), stats)


def _with_gate(columns: list[str] | None, gate: list[str]) -> list[str] | None:
    return None if columns is None else list(dict.fromkeys([*gate, *columns]))


def facts_and_catalog(spark: SparkSession, sf_dir: str, sol_columns: list[str] | None = None,
                      cr_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SOL facts, CR facts and the catalog of one ingest: every report is parsed and aggregated once."""
    sol_keys, sol = sol_ingest(spark, sf_dir, sol_columns)
    cr_keys, cr = cr_ingest(spark, sf_dir, cr_columns)
    ledger = sol_ledger(spark, sf_dir, sol).unionByName(cr_ledger(spark, sf_dir, cr))
    return (store.accepted_rows(store.kept_rows(sol_keys), sol), store.accepted_rows(store.kept_rows(cr_keys).drop("_p9"), cr),
            staged(_catalog(ledger), "catalogo"))


def _received_files(report: DataFrame) -> DataFrame:
    return staged(report.groupBy("archivo_id", "nombre_archivo").agg(F.count(F.lit(1)).alias("filas_recibidas"))
                  .withColumn("mac", C.office_of("nombre_archivo")), "recibidos")


def sol_ledger(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    stats = sol_stats(spark, sf_dir) if stats is None else stats
    return store.ledger_events(_received_files(sol_report(spark, sf_dir)), stats, "TIEMPOS_SOL", check_clerks=True)


def cr_ledger(spark: SparkSession, sf_dir: str, stats: DataFrame | None = None) -> DataFrame:
    stats = cr_stats(spark, sf_dir) if stats is None else stats
    return store.ledger_events(_received_files(cr_report(spark, sf_dir)), stats, "TIEMPOS_CR")


def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only status ledger of every received report file."""
    return sol_ledger(spark, sf_dir).unionByName(cr_ledger(spark, sf_dir))


def _catalog(ledger: DataFrame) -> DataFrame:
    return store.latest_state(ledger).withColumn("fecha_carga", F.lit(None).cast("timestamp_ntz"))


def ingest_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state per file = the file catalog the dashboards read."""
    return _catalog(ingest_ledger(spark, sf_dir))
