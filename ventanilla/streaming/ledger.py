"""D4 / W3 as a state machine per file: PENDIENTE, then PROCESADO or ERROR, with the load time.

Input is the stream of ledger events that confirmed batches publish
(``eventos`` of the store). Events come at least once and in any order: a
repeated event changes nothing, a result that overtakes its arrival waits in
the state, and a last state stays. The state of a file is a few fields, kept in
the state store of the checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ventanilla.operators.store import FAILED, PENDING, PROCESSED
from ventanilla.sources.fact_store import EVENTS, TABLES, FactStore

STATES = "estados"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TEXTS = ["nombre_archivo", "mac", "tipo", "estatus", "mensaje_error", "fecha_operativa", "fecha_inicio", "fecha_fin", "tipo_periodo", "fecha_carga"]
_OUT = "id bigint, cambio bigint, registros_insertados bigint, " + ", ".join(f"{c} string" for c in _TEXTS)


def next_changes(state: dict | None, events: list[dict]) -> tuple[dict | None, list[dict]]:
    """The state after some events of one file, and the changes they bring.

    ``state``: ``cambio`` (changes so far), ``estatus``, ``espera`` (a result that came before the arrival).
    """
    changes = []
    for e in events:
        state = state or {"cambio": 0, "estatus": None, "espera": None}
        if e["estatus"] == PENDING and state["estatus"] is None:
            waiting, state["espera"] = state["espera"], None
            todo = [e] + ([waiting] if waiting else [])
        elif e["estatus"] in (PROCESSED, FAILED) and state["estatus"] == PENDING:
            todo = [e]
        else:
            if e["estatus"] in (PROCESSED, FAILED) and state["estatus"] is None and state["espera"] is None:
                state["espera"] = e
            todo = []
        for x in todo:
            state["cambio"] += 1
            state["estatus"] = x["estatus"]
            changes.append({**x, "cambio": state["cambio"]})
    return state, changes


class FileLedger(StatefulProcessor):
    """Holds each file's state as one JSON text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("estado", "valor string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = json.loads(self.state.get()[0]) if self.state.exists() else None
        events = [json.loads(v) for pdf in rows for v in pdf["evento"]]
        events.sort(key=lambda e: e["seq"])
        new, changes = next_changes(old, events)
        if new:
            self.state.update((json.dumps(new),))
        if changes:
            names = [c.split()[0] for c in _OUT.split(", ")]
            yield pd.DataFrame([[key[0] if c == "id" else x.get(c) for c in names] for x in changes], columns=names)

    def close(self) -> None:
        pass


def start_ledger(store: FactStore, checkpoint: str, available_now: bool = True):
    """Stream the published events into the table of state changes (one folder per micro-batch, replaced by a retry)."""
    spark = store.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    events = spark.readStream.schema(TABLES["bitacora"]).parquet(store.path(EVENTS))
    texts = [F.col(c).cast("string").alias(c) for c in _TEXTS]
    packed = events.select("id", F.to_json(F.struct("seq", "registros_insertados", *texts)).alias("evento"))
    changes = packed.groupBy("id").transformWithStateInPandas(FileLedger(), outputStructType=_OUT, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(store.path(STATES), f"vuelta={batch_id}"))

    w = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def state_changes(store: FactStore) -> DataFrame:
    """Every change of every file, with typed dates."""
    rows = store.spark.read.schema(_OUT).parquet(store.path(STATES))
    dates = {c: F.col(c).cast("date") for c in ("fecha_operativa", "fecha_inicio", "fecha_fin")}
    return rows.withColumns({**dates, "fecha_carga": F.col("fecha_carga").cast("timestamp_ntz")})


def file_states(store: FactStore) -> DataFrame:
    """The last state of every file and the number of its changes."""
    rows = state_changes(store)
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "cambio").alias("_s")).select("id", "_s.*")
