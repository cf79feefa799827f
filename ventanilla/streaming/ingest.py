"""Continuous ingest of a landing folder (T1) with idempotent batch writes.

Each arriving export file is one report. A micro-batch is read, its
reports are parsed, cleaned, deduplicated and gated exactly as in batch
(the same library functions), and written with dynamic partition
overwrite on ``batch_id``: a retried batch has the same id and the same
files (the checkpoint fixes file discovery), so it replaces only its own
partitions and never doubles rows. No watermark is needed: every dedup key
contains the file, and a file never spans two micro-batches.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventanilla.functions.columns import office_of
from ventanilla.operators import clean, store
from ventanilla.operators.quality import CR_LENGTHS, SOL_LENGTHS
from ventanilla.session import staged
from ventanilla.sources import arrivals, reports
from ventanilla.sources.fact_store import TABLES

#: The streamed fact tables and the store's tables that have their columns.
FACTS = {"facts": "tramites", "facts_cr": "entregas_cr"}


def _received(cells: DataFrame, kind: str) -> DataFrame:
    """Every file of one kind that a batch brought, also those without usable rows."""
    return (arrivals.of_kind(cells, kind).groupBy("archivo_id", "nombre_archivo").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("mac", office_of("nombre_archivo")))


def sol_batch_facts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and ledger events of the SOL reports in a batch."""
    rows = arrivals.sol_rows_of_files(cells)
    t = F.col("funcionario_txt")
    clerk_ok = (F.length(t) > 0) & (F.upper(t) != clean.HEADER_CLERK) & (F.lower(t) != "nan")
    by_key = staged(store.ingest_by_key(rows, store.sol_keys(), "fecha", clerk_ok=clerk_ok), "sol-claves")
    stats = staged(store.file_stats(by_key, ["fecha"], lengths=SOL_LENGTHS), "sol-archivos")
    facts = store.accepted_rows(store.kept_rows(by_key), stats)
    return facts, store.ledger_events(_received(cells, "TIEMPOS_SOL"), stats, "TIEMPOS_SOL", check_clerks=True)


def cr_batch_facts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and ledger events of the CR reports in a batch."""
    rows = clean.cr_fact_projection(arrivals.cr_rows_of_files(cells)[0])
    by_key = staged(store.ingest_by_key(rows, store.cr_keys(), "fecha_entrega", valid=F.col("_p9")), "cr-claves")
    stats = staged(store.file_stats(by_key, ["fecha_entrega"], lengths=CR_LENGTHS), "cr-archivos")
    facts = store.accepted_rows(store.kept_rows(by_key).drop("_p9"), stats)
    return facts, store.ledger_events(_received(cells, "TIEMPOS_CR"), stats, "TIEMPOS_CR")


def stored(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The streamed rows of ``facts`` or ``facts_cr``; none where no batch had an accepted file."""
    schema = T.StructType.fromDDL(TABLES[FACTS[name]])
    path = os.path.join(out_dir, name)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _write_batch(df: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    # an office code read back from a folder name would lose its leading zero
    df = df.withColumns({f"_{k}": F.col(k) for k in keys})
    keys = [f"_{k}" for k in keys]
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id", *keys).parquet(path))


def ingest_batch(lines: DataFrame, batch_id: int, out_dir: str) -> None:
    """One batch of export lines of both kinds into ``facts``, ``facts_cr`` and ``ledger``.

    The same batch again replaces exactly its own output.
    """
    cells = reports.stored_cells(reports.cells_of_lines(lines))
    sol, sol_events = sol_batch_facts(cells)
    cr, cr_events = cr_batch_facts(cells)
    _write_batch(sol, os.path.join(out_dir, "facts"), batch_id, ["mac"])
    _write_batch(cr, os.path.join(out_dir, "facts_cr"), batch_id, ["mac"])
    _write_batch(sol_events.unionByName(cr_events), os.path.join(out_dir, "ledger"), batch_id, [])


def start_ingest(spark: SparkSession, landing_glob: str, out_dir: str, checkpoint: str,
                 files_per_batch: int = 16, available_now: bool = True):
    """Stream the export files matching ``landing_glob`` into ``out_dir``.
    The kind of a file is told from its name; other files bring no rows."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_batch)
             .text(landing_glob).select("value", "_metadata"))
    w = lines.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, out_dir)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def compact(spark: SparkSession, out_dir: str, target: str) -> None:
    """Rewrite streamed facts to the query layout (office, date), replacing only
    the (office, date) partitions present in the input. The rebalance hint lets
    adaptive execution cut a large office-day into several files and tasks."""
    (stored(spark, out_dir, "facts").hint("rebalance", "mac", "fecha").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("mac", "fecha").parquet(target))
