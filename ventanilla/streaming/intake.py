"""T1 into the fact store: a stream of arriving files, gated, ingested and confirmed batch by batch.

The stream carries file metadata only. A micro-batch is the list of at most
``files_per_batch`` paths; their lines are read by a splittable batch read.
Spark's file sources leave files of no bytes out, so a batch also lists those
of the landing folder that no other batch has taken. Facts, roll-ups, ledger events and
refusals of the batch become visible together (see ``sources.fact_store``); a
retried batch replaces what its earlier try confirmed. After the commit the
ledger events are published for ``streaming.ledger``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean, intake
from ventanilla.session import staged
from ventanilla.sources import arrivals, reports
from ventanilla.sources.fact_store import FactStore

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _report_name() -> Column:
    named = F.regexp_extract("path", r"reporte=([^/]+)/", 1)
    return F.url_decode(F.when(named != "", named).otherwise(F.element_at(F.split("path", "/"), -1)))


def received_files(files: DataFrame) -> DataFrame:
    """S1 + F1 + F2: id, name, office, kind and time of the files of a batch (one file per report)."""
    return (files.select(_report_name().alias("nombre_archivo"), "modificationTime")
            .select(intake.file_id().alias("archivo_id"), "nombre_archivo", C.office_of("nombre_archivo").alias("mac"),
                    C.report_type_of("nombre_archivo").alias("tipo"), F.col("modificationTime").cast("timestamp_ntz").alias("fecha_carga")))


def cells_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sheet rows of the given files, under the ids of ``received_files``."""
    lines = spark.read.text(paths).select("value", "_metadata")
    return reports.cells_of_lines(lines, by_directory=True).withColumn("archivo_id", intake.file_id())


def empty_files(target: FactStore, landing_glob: str, batch_id: int) -> DataFrame:
    """``path, modificationTime`` of the files of no bytes that no other confirmed batch holds."""
    spark = target.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(landing_glob)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(at) or []:
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(f.getPath().toString(), f.getModificationTime()) for f in inside if f.isFile() and f.getLen() == 0]
    files = spark.createDataFrame(found, "path string, ms bigint").select("path", F.timestamp_millis("ms").alias("modificationTime"))
    if not found:
        return files
    named = files.withColumn("nombre_archivo", _report_name()).withColumn("archivo_id", intake.file_id())
    return named.join(target.table("arribos", without=batch_id).select("archivo_id"), "archivo_id", "left_anti").select("path", "modificationTime")


def ingest_files(target: FactStore, batch_id: int, files: DataFrame, uploads: DataFrame | None = None, refuse_repeats: bool = False) -> None:
    """One batch of arrived files (``path, modificationTime``) into the store."""
    spark = target.spark
    paths = [r.path for r in files.select("path").distinct().collect()]  # at most files_per_batch
    if not paths:
        return
    cells = reports.stored_cells(cells_of(spark, paths))
    received = staged(received_files(files), "recibidos")
    faulty = arrivals.file_errors(received, cells).select("nombre_archivo", "motivo")
    errors = staged(received.join(faulty, "nombre_archivo").select("archivo_id", "motivo"), "errores")
    sol = arrivals.sol_rows_of_files(cells)
    cr = clean.cr_fact_projection(arrivals.cr_rows_of_files(cells)[0])
    intake.ingest_reports(target, batch_id, received, sol, cr, uploads, errors, intake.content_digests(cells), refuse_repeats)


def start_intake(target: FactStore, landing_glob: str, checkpoint: str, uploads: DataFrame | None = None,
                 refuse_repeats: bool = False, files_per_batch: int = 64, available_now: bool = True):
    """Stream the files matching ``landing_glob`` into the store."""
    files = (target.spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
             .load(landing_glob).select("path", "modificationTime"))

    def batch(df: DataFrame, batch_id: int) -> None:
        ingest_files(target, batch_id, df.unionByName(empty_files(target, landing_glob, batch_id)), uploads, refuse_repeats)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
