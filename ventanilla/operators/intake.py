"""What happens to a received report file (P20, Q3, D3, D4, D6, T2): gate, content digest, ingest into the store.

Every received file ends in exactly one place: refused uploads and, if so
wished, repeated contents in ``arribos`` with a reason; all others in the
ledger, as PENDIENTE (kinds that are only kept), PROCESADO or ERROR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean, quality, rollups, store
from ventanilla.sources.fact_store import FactStore

SOL, CR = "TIEMPOS_SOL", "TIEMPOS_CR"
REPEATED = "contenido_repetido"
#: Columns of an upload that the gate looks at.
UPLOAD_COLUMNS = ["tipo_esperado", "role_id", "mac_usuario"]


def file_id() -> Column:
    """An arrival's id from its name and time: the same file again at another time is a new one."""
    return F.xxhash64("nombre_archivo", "modificationTime")


def content_digests(cells: DataFrame) -> DataFrame:
    """``archivo_id, huella`` of every file's content, whatever the order in which its splits are read.

    Each line carries its sheet row number, so the sum of line hashes (twice,
    under different seeds) and the number of lines stand for the sequence. Sums
    are combined before the shuffle. Contents are told apart by 128 bits.
    """
    line = F.concat_ws("\t", F.col("row_no").cast("string"), F.array_join("cells", "\t", ""))

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)"))

    return (cells.groupBy("archivo_id").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
            .select("archivo_id", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("huella")))


def judge(received: DataFrame, uploads: DataFrame | None) -> DataFrame:
    """P20 at arrival: received files with ``motivo``, null where the upload is accepted.

    ``uploads`` holds one row per file name with the uploader's role, office and
    expected kind, and the time of the upload; without one, a file is accepted
    and its own time counts.
    """
    if uploads is None:
        return received.withColumn("motivo", F.lit(None).cast("string"))
    u = uploads.select(F.col("nombre_archivo").alias("_nombre"), F.col("fecha_carga").alias("_carga"), F.lit(True).alias("_subida"),
                       *[F.col(c).alias(f"_{c}") for c in UPLOAD_COLUMNS])
    j = received.join(u, received.nombre_archivo == u["_nombre"], "left")
    reason = quality.upload_reason(F.col("tipo"), F.col("mac"), F.col("_tipo_esperado"), F.col("_role_id"), F.col("_mac_usuario"))
    return j.select(*[c for c in received.columns if c != "fecha_carga"], F.coalesce("_carga", "fecha_carga").alias("fecha_carga"),
                    F.when(F.col("_subida"), reason).alias("motivo"))


def refuse_repeated(judged: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted files whose content an accepted file had before them (in ``known`` or earlier in this batch) are refused.

    Of equal contents in one batch the first upload stays (smallest time, then
    id); one aggregation per digest, so a content repeated without end is
    combined before the shuffle.
    """
    fine = judged.where("motivo is null and huella is not null")
    first = fine.groupBy("huella").agg(F.min(F.struct("fecha_carga", "archivo_id")).alias("_primero"))
    seen = known.where("motivo is null and huella is not null").select("huella").distinct().withColumn("_vista", F.lit(True))
    j = judged.join(first, "huella", "left").join(seen, "huella", "left")
    again = F.coalesce("_vista", F.lit(False)) | (F.col("_primero.archivo_id") != F.col("archivo_id"))
    return j.select(*judged.columns[:-1], F.coalesce("motivo", F.when(F.col("huella").isNotNull() & again, F.lit(REPEATED))).alias("motivo"))


def _final_events(arrived: DataFrame, stats: DataFrame, kind: str, errors: DataFrame | None) -> DataFrame:
    events = store.ledger_events(arrived.where(F.col("tipo") == kind).drop("tipo"), stats, kind, check_clerks=kind == SOL)
    if errors is None:
        return events
    unread = errors.select(F.col("archivo_id").alias("id"), F.col("motivo").alias("_error"))
    message = F.when((F.col("seq") == 1) & F.col("_error").isNotNull(), F.col("_error")).otherwise(F.col("mensaje_error"))
    return events.join(unread, "id", "left").withColumn("mensaje_error", message).drop("_error")


def ingest_reports(target: FactStore, batch_id: int, received: DataFrame, sol: DataFrame, cr: DataFrame,
                   uploads: DataFrame | None = None, errors: DataFrame | None = None, digests: DataFrame | None = None,
                   refuse_repeats: bool = False) -> None:
    """One batch of report files into the store, visible as a whole once it is complete.

    ``received``: ``archivo_id, nombre_archivo, mac, tipo, fecha_carga`` of every
    file of the batch, those without lines included. ``sol``, ``cr``: typed rows
    of the readable reports (CR after its fact projection). ``errors``:
    ``archivo_id, motivo`` of unreadable files. Rows are aggregated once per
    dedup key; facts, gate, roll-ups and ledger are made from that table.
    """
    batch = target.begin(batch_id)
    judged = judge(received.join(digests, "archivo_id", "left") if digests is not None
                   else received.withColumn("huella", F.lit(None).cast("string")), uploads)
    if refuse_repeats:
        judged = refuse_repeated(judged, target.table("arribos", without=batch_id))
    arrived = batch.put("arribos", judged)
    accepted = arrived.where("motivo is null")
    ids = accepted.select("archivo_id")

    t = F.col("funcionario_txt")
    clerk_ok = (F.length(t) > 0) & (F.upper(t) != clean.HEADER_CLERK) & (F.lower(t) != "nan")
    # a file's name and office are joined to the kept rows, not sorted and shuffled with every row
    files = accepted.groupBy("archivo_id").agg(F.min("nombre_archivo").alias("nombre_archivo"), F.min("mac").alias("mac"))

    def of_batch(rows: DataFrame) -> DataFrame:
        return rows.drop("nombre_archivo", "mac").join(ids, "archivo_id", "left_semi")

    sol_keys = store.with_files(batch.keep("sol", store.ingest_by_key(of_batch(sol), store.sol_keys(), "fecha", clerk_ok=clerk_ok)), files)
    cr_keys = store.with_files(batch.keep("cr", store.ingest_by_key(of_batch(cr), store.cr_keys(), "fecha_entrega", valid=F.col("_p9"))), files)
    sol_stats = batch.keep("sol_gate", store.file_stats(sol_keys, ["fecha"], lengths=quality.SOL_LENGTHS))
    cr_stats = batch.keep("cr_gate", store.file_stats(cr_keys, ["fecha_entrega"], lengths=quality.CR_LENGTHS))

    facts = batch.put("tramites", store.accepted_rows(store.kept_rows(sol_keys), sol_stats))
    facts_cr = batch.put("entregas_cr", store.accepted_rows(store.kept_rows(cr_keys).drop("_p9"), cr_stats))
    batch.put("resumen_sol", rollups.sol_rollup(facts))
    batch.put("resumen_cr", rollups.cr_rollup(facts_cr))

    only_kept = accepted.where(~F.col("tipo").isin(SOL, CR))
    pending = store.ledger_events(only_kept, sol_stats, SOL).where("seq = 0").drop("tipo")
    pending = pending.join(only_kept.select(F.col("archivo_id").alias("id"), "tipo"), "id")
    events = (_final_events(accepted, sol_stats, SOL, errors).unionByName(_final_events(accepted, cr_stats, CR, errors))
              .unionByName(pending))
    dated = accepted.select(F.col("archivo_id").alias("id"), "fecha_carga")
    written = batch.put("bitacora", events.join(dated, "id"))
    batch.commit()
    batch.publish(written)


def catalog(target: FactStore) -> DataFrame:
    """W3 + D4: the latest state of every file of the store, with its load time."""
    return store.latest_state(target.table("bitacora"))


def destinations(target: FactStore) -> DataFrame:
    """Every received file with its one last state: the ledger's, or RECHAZADO with the reason."""
    done = catalog(target).select(F.col("id").alias("archivo_id"), "estatus", "mensaje_error")
    j = target.table("arribos").join(done, "archivo_id", "left")
    return j.select("nombre_archivo", "mac", "tipo", F.when(F.col("motivo").isNotNull(), F.lit("RECHAZADO")).otherwise(F.col("estatus")).alias("estatus"),
                    F.coalesce("motivo", "mensaje_error", F.lit("")).alias("motivo"),
                    F.date_format("fecha_carga", "yyyy-MM-dd HH:mm:ss").alias("fecha_carga"))
