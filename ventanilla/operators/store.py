"""Fact store semantics without a transactional database.

* First-row-wins dedup is an aggregation with ``min_by(struct, row_no)``:
  it combines map-side, so a hot key (one third of all rows) is reduced in
  every map task before the shuffle, unlike a ``row_number`` window that
  would pull the whole hot key into one task.
* File-level atomicity (one transaction per file) becomes a per-file gate:
  a small per-file aggregate joined back by file id (AQE turns it into a
  broadcast join at run time when its measured size is small, and splits
  skewed partitions of a sort-merge join otherwise).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = "archivo_id"
SOL_DEDUP_KEYS = ["folio", "funcionario", "terminal"]          # plus the file; null = ''
CR_DEDUP_KEYS = ["solicitud", "terminal"]                      # plus file and date
# Texts written to the ledger (fixed values of the status life-cycle).
PENDING, PROCESSED, FAILED = "PENDIENTE", "PROCESADO", "ERROR"
MSG_EMPTY_AFTER_CLEAN = {"TIEMPOS_SOL": "El archivo quedó sin registros después de la limpieza",
                         "TIEMPOS_CR": "El archivo CR quedó sin registros después de la limpieza"}
MSG_NOT_NULL = 'null value in column "{col}" violates not-null constraint'
MSG_NO_RANKING = "No se generó ranking por funcionario"
MSG_CHECK = 'new row violates check constraint on column "{col}"'
MSG_LENGTH = "value too long for type character varying({n})"
MSG_RANGE = "numeric field overflow"
# Offices the fact tables accept (CHECK constraint); other rows reject their file.
ALLOWED_OFFICES = ["090852", "090853"]
_KEY = "_k_"                                                   # before the name of a dedup key
PERIOD_DAILY, PERIOD_WEEKLY = "DIARIO", "SEMANAL"


def accepted_rows(kept: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of accepted files only (left-semi join on the file id)."""
    return kept.join(gate.where("aceptado").select(FILE), FILE, "left_semi")


def ingest_by_key(rows: DataFrame, keys: list[str], date_col: str, valid: Column | None = None,
                  clerk_ok: Column | None = None, order_col: str = "row_no") -> DataFrame:
    """One aggregation per dedup key (file first): the first valid row in file
    order (D1/D2) plus the key's share of the per-file roll-up over *all*
    cleaned rows (A15 dates, row counts, Q3 clerk rows). Partial aggregation,
    so a hot key is reduced map-side. Rows with texts are aggregated in sorted
    order; a hash before the keys tells most of them apart in one comparison.

    ``keys`` name columns; a missing text counts as the empty one, which cleaned rows
    do not hold. A key stands once in the sorted rows and in the result (``_k_<name>``),
    ``_first`` has the other columns."""
    names = [_KEY + k for k in keys]
    texts = _texts(rows)
    others = [c for c in rows.columns if c not in keys]
    date_col = _KEY + date_col if date_col in keys else date_col
    v = valid if valid is not None else F.lit(True)
    c = clerk_ok if clerk_ok is not None else F.lit(True)
    return (rows.select(*[(F.coalesce(k, F.lit("")) if k in texts else F.col(k)).alias(n) for k, n in zip(keys, names)],
                        *others, v.alias("_valid"), c.alias("_clerk"))
                .groupBy(F.xxhash64(*names).alias("_h"), *names)
                .agg(F.min_by(F.struct(*others), F.when(F.col("_valid"), F.col(order_col))).alias("_first"),
                     F.min(date_col).alias("_dmin"), F.max(date_col).alias("_dmax"),
                     F.count(F.lit(1)).alias("_n"), F.count_if("_clerk").alias("_nc"))
                .drop("_h"))


def _texts(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}


def _kept_columns(by_key: DataFrame) -> dict[str, Column]:
    """The columns of the kept rows: keys, columns joined to the keys (without ``_`` before the name) and ``_first``'s."""
    texts = _texts(by_key)
    out = {n.removeprefix(_KEY): (F.nullif(F.col(n), F.lit("")) if n in texts else F.col(n)) for n in by_key.columns if n.startswith(_KEY)}
    out |= {n: F.col(n) for n in by_key.columns if not n.startswith("_")}
    return out | {f.name: F.col("_first").getField(f.name) for f in by_key.schema["_first"].dataType}


def kept_rows(by_key: DataFrame) -> DataFrame:
    """The kept row of every key that has a valid one."""
    return by_key.where(F.col("_first").isNotNull()).select(*[c.alias(n) for n, c in _kept_columns(by_key).items()])


def with_files(by_key: DataFrame, files: DataFrame) -> DataFrame:
    """By-key rows with the columns of their file (one row per ``archivo_id``)."""
    return by_key.join(files, by_key[_KEY + FILE] == files[FILE]).drop(files[FILE])


def file_stats(by_key: DataFrame, required: list[str], office_col: str | None = "mac",
               lengths: dict[str, int] | None = None, max_hundredths: int = 10 ** 10) -> DataFrame:
    """Per file: A15 roll-up (over all cleaned rows), D3 gate, Q3 counts.

    The gate looks at kept rows: a NULL in a required column, an office
    outside the allowed set, a text longer than its column or minutes outside
    NUMERIC(10,2) rejects the whole file, as one transaction."""
    row = _kept_columns(by_key)
    null_viol = reduce(lambda a, b: a | b, [row[c].isNull() for c in required])
    office_viol = (~row[office_col].isin(ALLOWED_OFFICES)) if office_col else F.lit(False)
    kept = F.col("_first").isNotNull()
    long_viol = [(n, F.coalesce(F.length(row[c]) > n, F.lit(False))) for c, n in (lengths or {}).items()]
    range_viol = F.coalesce(F.abs(row["centesimas"]) >= max_hundredths, F.lit(False)) if lengths else F.lit(False)
    viols = [(MSG_NOT_NULL.format(col=required[0]), null_viol), (MSG_CHECK.format(col=office_col or ""), office_viol),
             *[(MSG_LENGTH.format(n=n), viol) for n, viol in long_viol], (MSG_RANGE, range_viol)]
    # reasons by their rank among all texts: whole numbers are aggregated by hash, texts would be sorted
    texts = sorted({text for text, _ in viols})
    reason = reduce(lambda rest, v: F.when(kept & v[1], F.lit(texts.index(v[0]))).otherwise(rest), reversed(viols), F.lit(None).cast("int"))
    judged = by_key.select(F.col(_KEY + FILE).alias(FILE), "_n", "_dmin", "_dmax", "_nc", kept.alias("_kept"), reason.alias("_reason"))
    return (judged.groupBy(FILE)
                  .agg(F.sum("_n").alias("filas_limpias"), F.min("_dmin").alias("fecha_inicio"),
                       F.max("_dmax").alias("fecha_fin"), F.sum("_nc").alias("filas_funcionario"),
                       F.count_if("_kept").alias("filas_conservadas"),
                       F.count("_reason").alias("violaciones"),
                       F.min("_reason").alias("_motivo"))
                  .withColumn("motivo_rechazo", F.get(F.array(*[F.lit(t) for t in texts]), F.col("_motivo"))).drop("_motivo")
                  .withColumn("aceptado", F.col("violaciones") == 0)
                  .withColumn("fecha_operativa", F.col("fecha_fin"))
                  .withColumn("tipo_periodo", F.when(F.col("fecha_inicio") != F.col("fecha_fin"), F.lit(PERIOD_WEEKLY))
                              .otherwise(F.lit(PERIOD_DAILY))))


def new_rows_only(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose (null-tolerant) key is not stored yet."""
    def keyed(df):
        return df.withColumns({f"_j_{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    jk = [f"_j_{k}" for k in keys]
    s = keyed(stored).select(*jk)
    return keyed(batch).join(s, jk, "left_anti").drop(*jk)


def sol_keys() -> list[str]:
    return [FILE, *SOL_DEDUP_KEYS]


def cr_keys() -> list[str]:
    return [FILE, *CR_DEDUP_KEYS, "fecha_entrega"]


def ledger_events(raw_files: DataFrame, stats: DataFrame, tipo: str, check_clerks: bool = False) -> DataFrame:
    """Append-only status events per received file: PENDIENTE (seq 0), then
    the final PROCESADO / ERROR (seq 1) with dates, period and row count.

    ``raw_files``: one row per received file (id, name, office); ``stats``:
    per-file roll-up + gate (``file_stats``). Q3 reasons: nothing left after
    cleaning, a NOT NULL violation (the whole file is rejected), and for SOL
    no clerk rows for the ranking (rows stay stored, status is ERROR)."""
    base = raw_files.select(FILE, "nombre_archivo", "mac")
    pending = base.select(
        F.col(FILE).alias("id"), "nombre_archivo", "mac", F.lit(tipo).alias("tipo"),
        F.lit(0).alias("seq"), F.lit(PENDING).alias("estatus"),
        F.lit(None).cast("string").alias("mensaje_error"), F.lit(True).alias("activo"),
        F.lit(None).cast("date").alias("fecha_operativa"), F.lit(None).cast("date").alias("fecha_inicio"),
        F.lit(None).cast("date").alias("fecha_fin"), F.lit(None).cast("string").alias("tipo_periodo"),
        F.lit(0).cast("bigint").alias("registros_insertados"))
    j = base.join(stats, FILE, "left")
    empty = F.coalesce(F.col("filas_limpias"), F.lit(0)) == 0
    rejected = F.coalesce(F.col("violaciones"), F.lit(0)) > 0
    no_rank = (F.coalesce(F.col("filas_funcionario"), F.lit(0)) == 0) if check_clerks else F.lit(False)
    msg = (F.when(empty, F.lit(MSG_EMPTY_AFTER_CLEAN.get(tipo, MSG_EMPTY_AFTER_CLEAN["TIEMPOS_SOL"])))
            .when(rejected, F.col("motivo_rechazo"))
            .when(no_rank, F.lit(MSG_NO_RANKING)))
    ok = msg.isNull()
    # On ERROR only status and message change: the row count keeps its default 0
    # even when the rows were committed before a later step failed (no ranking).
    final = j.select(
        F.col(FILE).alias("id"), "nombre_archivo", "mac", F.lit(tipo).alias("tipo"),
        F.lit(1).alias("seq"), F.when(ok, F.lit(PROCESSED)).otherwise(F.lit(FAILED)).alias("estatus"),
        msg.alias("mensaje_error"), F.lit(True).alias("activo"),
        F.when(ok, F.col("fecha_operativa")).alias("fecha_operativa"),
        F.when(ok, F.col("fecha_inicio")).alias("fecha_inicio"),
        F.when(ok, F.col("fecha_fin")).alias("fecha_fin"),
        F.when(ok, F.col("tipo_periodo")).alias("tipo_periodo"),
        F.when(ok, F.col("filas_conservadas")).otherwise(F.lit(0)).cast("bigint").alias("registros_insertados"))
    return pending.unionByName(final)


def latest_state(ledger: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Latest event per file (``max_by`` with partial aggregation)."""
    cols = ledger.columns
    return (ledger.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_s"))
                  .select("_s.*").drop(seq))

