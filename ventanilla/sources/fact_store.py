"""A fact store of plain Parquet folders in which a batch becomes visible as a whole.

Every try at a batch writes its tables under a folder of its own
(``<table>/intento=<id>``). One small row in ``confirmaciones`` then names
the try that counts for the batch; readers join their table with the latest
confirmation of every batch. So facts, roll-ups, ledger events and refused
files of a batch appear together or not at all: a batch that dies between two
tables leaves folders that nobody reads, and a batch run again replaces what
its earlier try had confirmed.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = "archivo_id bigint, nombre_archivo string, mac string"
_GROUP = "tramites bigint, suma bigint, con_tiempo bigint, minimo bigint, maximo bigint, atipicos bigint"
#: The tables of the store.
TABLES = {
    "tramites": f"{_FILE}, row_no bigint, fecha date, folio string, tipo_tramite string, categoria string, funcionario string, "
                "terminal string, domicilio_visible string, estatus_tramite string, hora_inicio timestamp_ntz, hora_fin timestamp_ntz, "
                "duracion_us bigint, centesimas bigint, terminal_txt string, funcionario_txt string, dentro_norma boolean",
    "entregas_cr": f"{_FILE}, row_no bigint, fecha_entrega date, solicitud string, folio_nec string, terminal string, "
                   "hora_inicio timestamp_ntz, hora_fin timestamp_ntz, centesimas bigint, dentro_norma boolean",
    "bitacora": "id bigint, nombre_archivo string, mac string, tipo string, seq int, estatus string, mensaje_error string, activo boolean, "
                "fecha_operativa date, fecha_inicio date, fecha_fin date, tipo_periodo string, registros_insertados bigint, "
                "fecha_carga timestamp_ntz",
    "arribos": f"{_FILE}, tipo string, fecha_carga timestamp_ntz, huella string, motivo string",
    "resumen_sol": f"archivo_id bigint, mac string, fecha date, funcionario string, {_GROUP}, terminales array<string>",
    "resumen_cr": f"archivo_id bigint, terminal string, {_GROUP}",
}
_TRY, _COMMITS, _WORK = "intento", "confirmaciones", "obra"
#: Ledger events of confirmed batches, at least once each, for streams.
EVENTS = "eventos"
_COMMIT_SCHEMA = "lote bigint, intento string, orden bigint"


class FactStore:
    """Committed tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def confirmed(self) -> DataFrame:
        """``lote, intento``: the try that counts for every confirmed batch."""
        if not self._there(self.path(_COMMITS)):
            return self.spark.createDataFrame([], "lote bigint, intento string")
        rows = self.spark.read.schema(_COMMIT_SCHEMA).parquet(self.path(_COMMITS))
        return rows.groupBy("lote").agg(F.max_by(_TRY, "orden").alias(_TRY))

    def table(self, name: str, without: int | None = None) -> DataFrame:
        """The rows of a table that confirmed batches wrote, but for the batch ``without``."""
        schema = T.StructType.fromDDL(TABLES[name])
        if not self._there(self.path(name)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add(_TRY, T.StringType())).parquet(self.path(name))
        tries = self.confirmed() if without is None else self.confirmed().where(F.col("lote") != without)
        return rows.join(tries.select(_TRY), _TRY, "left_semi").drop(_TRY)

    def begin(self, batch_id: int) -> Batch:
        return Batch(self, batch_id)


class Batch:
    """One try at writing a batch; nothing of it is seen before ``commit``."""

    def __init__(self, store: FactStore, batch_id: int):
        self.store, self.batch_id, self.attempt = store, batch_id, f"i{uuid.uuid4().hex}"

    def _folder(self, name: str) -> str:
        return self.store.path(name, f"{_TRY}={self.attempt}")

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Write the batch's rows of a table and read them back."""
        schema = T.StructType.fromDDL(TABLES[name])
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(self._folder(name))
        return self.store.spark.read.schema(schema).parquet(self._folder(name))

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate table of this try once, so that what follows computes it only once."""
        path = self.store.path(_WORK, self.attempt, name)
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def commit(self) -> None:
        """Make the whole batch visible: one row, in one file."""
        spark = self.store.spark
        row = spark.range(1).select(F.lit(self.batch_id).cast("bigint").alias("lote"), F.lit(self.attempt).alias(_TRY),
                                    F.lit(time.time_ns()).cast("bigint").alias("orden"))
        row.coalesce(1).write.mode("append").parquet(self.store.path(_COMMITS))
        self._drop_work()

    def publish(self, events: DataFrame) -> None:
        """Hand ledger events on to streams; to be called after ``commit``."""
        events.write.mode("append").parquet(self.store.path(EVENTS))

    def _drop_work(self) -> None:
        """The intermediate tables of this try, which nothing reads any more."""
        p = self.store.spark._jvm.org.apache.hadoop.fs.Path(self.store.path(_WORK, self.attempt))
        p.getFileSystem(self.store.spark._jsc.hadoopConfiguration()).delete(p, True)
