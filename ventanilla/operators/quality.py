"""Data quality from the schema constraints.

Q1 counts every rule in one aggregation pass per table and unpivots the
result, so the cost is one scan regardless of the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators.store import ALLOWED_OFFICES

# --- Fixed values: text length limits, NUMERIC(10,2) range ---
SOL_LENGTHS = {"folio": 50, "tipo_tramite": 100, "categoria": 100, "funcionario": 150,
               "terminal": 50, "domicilio_visible": 20, "nombre_archivo": 255}
CR_LENGTHS = {"solicitud": 50, "folio_nec": 50, "terminal": 50, "nombre_archivo": 255}
MAX_HUNDREDTHS = 10 ** 10          # NUMERIC(10,2): |minutes| < 10^8
# ---------------------------------------------------------------------------


def _rules(required: str, lengths: dict) -> dict:
    rules = {
        "mac_fuera_de_catalogo": ~F.col("mac").isin(ALLOWED_OFFICES),
        f"{required}_nula": F.col(required).isNull(),
        "minutos_fuera_de_rango": F.abs(F.col("centesimas")) >= MAX_HUNDREDTHS,
    }
    for c, n in lengths.items():
        rules[f"{c}_mayor_a_{n}"] = F.length(c) > n
    return rules


def rule_counts(df: DataFrame, table_name: str, required: str, lengths: dict) -> DataFrame:
    """Q1: rows breaking each rule (one pass, then unpivot to (tabla, regla, filas))."""
    rules = _rules(required, lengths)
    wide = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()])
    return (wide.unpivot([], list(rules), "regla", "filas")
                .select(F.lit(table_name).alias("tabla"), "regla", F.col("filas").cast("bigint")))


def quality_counts(sol_kept: DataFrame, cr_kept: DataFrame) -> DataFrame:
    return (rule_counts(sol_kept, "tramites", "fecha", SOL_LENGTHS)
            .unionByName(rule_counts(cr_kept, "entregas_cr", "fecha_entrega", CR_LENGTHS)))


def unique_violations(df: DataFrame, key: str, label: str) -> DataFrame:
    """Q2: values of a unique key that occur more than once."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("repeticiones")).where("repeticiones > 1")
              .select(F.lit(label).alias("clave"), F.col(key).cast("string").alias("valor"),
                      F.col("repeticiones").cast("bigint")))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, label: str) -> DataFrame:
    """Rows, and rows whose foreign key has no parent: one left join to the
    distinct parent keys, one aggregation."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return (child.join(p, child[fk] == p._pk, "left")
                 .agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("_pk").isNull()).alias("huerfanos"))
                 .select(F.lit(label).alias("relacion"), F.col("filas").cast("bigint"),
                         F.col("huerfanos").cast("bigint")))


def upload_reason(tipo: Column, mac: Column, expected: Column, role: Column, user_office: Column, admin_role: int = 1) -> Column:
    """P20: why an upload is refused, null if it is not."""
    admin = role == admin_role
    return (F.when(expected.isNotNull() & (tipo != expected), F.lit("tipo_distinto"))
             .when(~admin & (mac == C.UNKNOWN_OFFICE), F.lit("mac_desconocido"))
             .when(~admin & user_office.isNull(), F.lit("usuario_sin_mac"))
             .when(~admin & (mac != user_office), F.lit("mac_ajeno")))


def upload_gate(uploads: DataFrame, admin_role: int = 1) -> DataFrame:
    """P20: accept or reject an upload: expected type, known office, the
    uploader's own office (administrators may upload any office)."""
    tipo = C.report_type_of("nombre_archivo")
    mac = C.office_of("nombre_archivo")
    reason = upload_reason(tipo, mac, F.col("tipo_esperado"), F.col("role_id"), F.col("mac_usuario"), admin_role)
    return uploads.select("id", mac.alias("mac"), tipo.alias("tipo"),
                          reason.isNull().alias("aceptado"), F.coalesce(reason, F.lit("")).alias("motivo"))
