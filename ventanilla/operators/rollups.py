"""Per-file partial states of the dashboard metrics (A6-A9, A12, P14, J8), merged when read.

Sums, counts, extremes and the exact sets of a group (a clerk's terminals,
which are few; clerks are rows of their own) are written at ingest. Every
dashboard figure is a merge of these small rows; fact rows are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import dashboard


def _partial() -> list[Column]:
    over = F.col("centesimas") > dashboard.OVER
    return [F.count(F.lit(1)).alias("tramites"), F.sum("centesimas").alias("suma"), F.count("centesimas").alias("con_tiempo"),
            F.min("centesimas").alias("minimo"), F.max("centesimas").alias("maximo"), F.count_if(over).alias("atipicos")]


def _merged() -> list[Column]:
    return [F.sum("tramites").alias("tramites"), F.sum("suma").alias("suma"), F.sum("con_tiempo").alias("con_tiempo"),
            F.min("minimo").alias("minimo"), F.max("maximo").alias("maximo"), F.sum("atipicos").alias("atipicos")]


def sol_rollup(facts: DataFrame) -> DataFrame:
    """One row per file, office, date and clerk (a missing clerk is one)."""
    terminal = F.coalesce(F.col("terminal"), F.lit(C.NO_TERMINAL))
    return facts.groupBy("archivo_id", "mac", "fecha", "funcionario").agg(*_partial(), F.collect_set(terminal).alias("terminales"))


def cr_rollup(facts: DataFrame) -> DataFrame:
    """One row per file and terminal (a missing terminal is one)."""
    return facts.groupBy("archivo_id", "terminal").agg(*_partial())


def file_summary(rollup: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """A6 from partial states."""
    g = rollup.groupBy(*keys).agg(*_merged(), F.count_distinct("funcionario").alias("funcionarios_activos"))
    mean = C.rounded_mean_hundredths("suma", "con_tiempo")
    return g.select(*keys, F.col("tramites").alias("total_tramites"), mean.alias("promedio_centesimas"),
                    C.hundredths_to_hms(mean, C.NO_DATA).alias("promedio_mac"), "funcionarios_activos")


def cr_summary(rollup: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """A8 from partial states."""
    g = rollup.groupBy(*keys).agg(*_merged())
    return g.select(*keys, F.col("tramites").alias("total_entregas"), C.mean_hundredths_to_hms("suma", "con_tiempo").alias("promedio_tiempo"),
                    C.hundredths_to_hms("minimo").alias("tiempo_minimo"), C.hundredths_to_hms("maximo").alias("tiempo_maximo"), "atipicos")


def clerk_list(rollup: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """A7 + F12 from partial states, without the position."""
    terminals = F.array_sort(F.array_distinct(F.flatten(F.collect_list("terminales"))))
    g = rollup.groupBy(*keys, "funcionario").agg(*_merged(), F.array_join(terminals, ", ").alias("terminales"))
    mean = C.rounded_mean_hundredths("suma", "con_tiempo")
    return g.select(*keys, "funcionario", "tramites", mean.alias("promedio_centesimas"),
                    C.hundredths_to_hms(F.coalesce(mean, F.lit(0))).alias("promedio_tiempo"), F.col("atipicos").alias("casos_atipicos"),
                    "terminales", C.performance_label(F.col("tramites"), mean, F.col("atipicos")).alias("desempeno"))


def terminal_list(rollup: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """A9 from partial states, without the position."""
    name = F.coalesce(F.col("terminal"), F.lit(C.NO_VALUE)).alias("terminal")
    g = rollup.groupBy(*keys, name).agg(*_merged())
    return g.select(*keys, "terminal", F.col("tramites").alias("entregas"), C.mean_hundredths_to_hms("suma", "con_tiempo").alias("promedio"),
                    C.hundredths_to_hms("minimo").alias("minimo"), C.hundredths_to_hms("maximo").alias("maximo"))


ALL = "*"


def picks_by_scope(catalog: DataFrame, fecha=None) -> DataFrame:
    """The file that O1 picks for every scope, an office or all of them (``*``)."""
    scoped = catalog.withColumn("_alcance", F.explode(F.array(F.col("mac"), F.lit(ALL))))
    real = F.struct(*[F.col(c) for c in dashboard.CATALOG_PICK_COLUMNS])
    cond = F.col("tipo").isin(dashboard.SOL_TYPE, dashboard.CR_TYPE) & (F.col("estatus") == dashboard.PROCESSED) & F.col("activo")
    if fecha:
        cond = cond & (F.col("fecha_operativa") == F.lit(fecha).cast("date"))
    return (scoped.where(cond).groupBy("tipo", F.col("_alcance").alias("alcance"))
            .agg(F.min_by(real, dashboard.pick_key()).alias("_p")).select("alcance", "_p.*"))


def dashboards_by_scope(catalog: DataFrame, sol: DataFrame, cr: DataFrame, fecha=None) -> DataFrame:
    """P14 + J8 for every scope with a file, from the partial states of the picked files."""
    picks = picks_by_scope(catalog, fecha)
    left = dashboard._sol_side(picks.where(F.col("tipo") == dashboard.SOL_TYPE), sol, ["alcance"], file_summary)
    right = dashboard._cr_side(picks.where(F.col("tipo") == dashboard.CR_TYPE), cr, ["alcance"], cr_summary)
    return dashboard._assemble(left, right, ["alcance"])


def user_dashboards(users: DataFrame, by_scope: DataFrame) -> DataFrame:
    """P13 + P14: the dashboard row of every user; the default record where the user's scope has no file."""
    scope = dashboard.scope_of(F.col("role_id"), F.col("mac_asignado"))
    u = users.select("id", "username", scope.alias("_u"))
    texts = {"fuente_sol": C.NO_REPORT, "fuente_cr": C.NO_REPORT, "tipo_periodo_sol": C.NO_VALUE, "tipo_periodo_cr": C.NO_VALUE,
             "mac_archivo": C.NO_DATA, "fecha_operativa": C.NO_DATA, "relacion_global": "0.00", "promedio_mac": C.NO_DATA,
             "promedio_entrega": C.NO_DATA, "tiempo_minimo": C.NO_DATA, "tiempo_maximo": C.NO_DATA}
    counts = ["total_tramites", "total_entregas", "funcionarios_activos", "atipicos_cr"]
    j = u.join(by_scope, u["_u"] == by_scope["alcance"], "left")
    return j.select("id", "username", F.col("_u").alias("alcance"), "archivo_id",
                    *[F.coalesce(F.col(c).cast("string"), F.lit(t)).alias(c) for c, t in texts.items()],
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
