"""Report metrics with the relative outlier rule.

The reference computes these per report file. Here every function takes
``keys`` (default: the file id) and answers for all groups in one job.
The threshold of a group (factor x mean) is a small per-group aggregate
joined back on the group keys -- never a window over the whole group and
never a driver round trip. Comparisons are exact: ``t > f*mean`` becomes
``t * n * q > p * sum`` with f = p/q, in DECIMAL(38,0).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators.common import attach

FILE = ["archivo_id"]
OUTLIER_FACTOR = 1.5
CRITERION_TEXT = "Tiempo mayor a {f} veces el promedio general"
NO_VALID = "Sin datos válidos"
DELIVERY = "ENTREGA"


def _frac(factor: float) -> tuple[int, int]:
    fr = Fraction(str(factor))
    return fr.numerator, fr.denominator


def _dec(c) -> Column:
    return C.col_(c).cast("decimal(38,0)")


def group_thresholds(rows: DataFrame, keys=FILE, value: str = "duracion_us") -> DataFrame:
    """Per group: all rows, rows with a valid value, and their exact sum."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.count(value).alias("_n_valid"),
        F.sum(_dec(value)).alias("_sum_valid"))


def _with_outlier_flag(rows: DataFrame, keys, value: str, factor: float) -> DataFrame:
    p, q = _frac(factor)
    thr = group_thresholds(rows, keys, value).select(*keys, "_n_valid", "_sum_valid")
    out = (_dec(value) * F.col("_n_valid") * q) > (F.col("_sum_valid") * p)
    return attach(rows, thr, keys).withColumn("_outlier", F.coalesce(out, F.lit(False)))


def global_threshold(rows: DataFrame, keys=FILE, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """A1: rows, mean duration and threshold = factor x mean per group."""
    p, q = _frac(factor)
    g = group_thresholds(rows, keys)
    n, s = F.col("_n_valid"), F.col("_sum_valid")
    mean_us = F.when(n > 0, C.idiv(s, n))
    thr_us = F.when(n > 0, C.idiv(s * p, n * q))
    return g.select(
        *keys, "total_registros", n.alias("registros_validos"),
        mean_us.cast("bigint").alias("promedio_us"), thr_us.cast("bigint").alias("umbral_us"),
        F.when(n > 0, C.hms(C.idiv(s, n * C.US_PER_SECOND))).otherwise(F.lit(NO_VALID)).alias("promedio_tiempo"),
        F.when(n > 0, C.hms(C.idiv(s * p, n * q * C.US_PER_SECOND))).otherwise(F.lit(NO_VALID)).alias("umbral_atipico"),
        F.when(n > 0, F.lit(CRITERION_TEXT.format(f=factor))).otherwise(F.lit(NO_VALID)).alias("criterio_atipico"))


def terminal_share(rows: DataFrame, keys=FILE, terminal: str = "terminal_txt") -> DataFrame:
    """A2 + F14: rows per raw terminal value (null is a group) and its share."""
    per = rows.groupBy(*keys, terminal).agg(F.count(F.lit(1)).alias("registros"))
    tot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return (attach(per, tot, keys)
               .select(*keys, F.col(terminal).alias("terminal"), "registros",
                       C.hundredths_to_double(C.percent_hundredths(F.col("registros"), F.col("_total")))
                        .alias("porcentaje")))


def category_counts(rows: DataFrame, keys=FILE) -> DataFrame:
    """A3: rows per category."""
    return rows.groupBy(*keys, "categoria").agg(F.count(F.lit(1)).alias("cantidad"))


def clerk_metrics(rows: DataFrame, keys=FILE, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """A4: per clerk (P10 filter applied): counts split by ENTREGA, means,
    min / max, outliers over the group threshold and their share of all the
    clerk's rows, distinct terminals in order of first appearance.

    Two partial aggregations: (keys, clerk, terminal) then (keys, clerk); the
    terminal list is bounded by the distinct terminals of one clerk."""
    flagged = _with_outlier_flag(rows, keys, "duracion_us", factor)
    from ventanilla.operators.clean import clerk_rows
    r = clerk_rows(flagged)
    ent = F.col("categoria") == DELIVERY
    us = F.col("duracion_us")
    term = C.strip(F.col("terminal_txt").cast("string"))
    pre = r.groupBy(*keys, "funcionario_txt", term.alias("_term")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ent).alias("n_ent"),
        F.count(us).alias("v"), F.sum(_dec(us)).alias("s"), F.min(us).alias("mn"), F.max(us).alias("mx"),
        F.count(F.when(ent, us)).alias("v_ent"), F.sum(_dec(F.when(ent, us))).alias("s_ent"),
        F.count(F.when(~ent, us)).alias("v_tr"), F.sum(_dec(F.when(~ent, us))).alias("s_tr"),
        F.count_if(F.col("_outlier") & us.isNotNull()).alias("atip"),
        F.min("row_no").alias("first_row"))
    agg = pre.groupBy(*keys, "funcionario_txt").agg(
        F.sum("n").alias("total_registros"), F.sum("n_ent").alias("entregas"),
        F.sum("v").alias("v"), F.sum("s").alias("s"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
        F.sum("v_ent").alias("v_ent"), F.sum("s_ent").alias("s_ent"),
        F.sum("v_tr").alias("v_tr"), F.sum("s_tr").alias("s_tr"),
        F.sum("atip").alias("tramites_atipicos"),
        F.array_sort(F.collect_list(F.when(F.col("_term").isNotNull(),
                                           F.struct(F.col("first_row"), F.col("_term"))))).alias("_terms"))

    def mean(v, s):
        return F.when(F.col(v) > 0, C.idiv(F.col(s), F.col(v))).cast("bigint")

    terms = F.array_join(F.transform("_terms", lambda x: x["_term"]), ", ")
    return agg.select(
        *keys, F.col("funcionario_txt").alias("funcionario"),
        F.col("total_registros").cast("bigint").alias("total_registros"),
        F.col("entregas").cast("bigint").alias("entregas"),
        (F.col("total_registros") - F.col("entregas")).cast("bigint").alias("tramites_reales"),
        mean("v", "s").alias("promedio_general_us"), mean("v_ent", "s_ent").alias("promedio_entregas_us"),
        mean("v_tr", "s_tr").alias("promedio_tramites_us"),
        F.col("mn").alias("tiempo_minimo_us"), F.col("mx").alias("tiempo_maximo_us"),
        F.col("tramites_atipicos").cast("bigint").alias("tramites_atipicos"),
        C.hundredths_to_double(C.percent_hundredths(F.col("tramites_atipicos"), F.col("total_registros")))
         .alias("porcentaje_atipicos"),
        F.when(F.size("_terms") > 0, terms).otherwise(F.lit(C.NO_VALUE)).alias("terminales"))


def clerk_category_metrics(rows: DataFrame, keys=FILE, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """A5: per clerk and category: count, mean, min, max, outliers (group threshold)."""
    from ventanilla.operators.clean import clerk_rows
    r = clerk_rows(_with_outlier_flag(rows, keys, "duracion_us", factor))
    us = F.col("duracion_us")
    g = r.groupBy(*keys, F.col("funcionario_txt").alias("funcionario"), F.col("categoria").alias("tipo_tramite")).agg(
        F.count(F.lit(1)).alias("cantidad"), F.count(us).alias("_v"), F.sum(_dec(us)).alias("_s"),
        F.min(us).alias("_mn"), F.max(us).alias("_mx"),
        F.count_if(F.col("_outlier") & us.isNotNull()).alias("tramites_atipicos"))
    return g.select(
        *keys, "funcionario", "tipo_tramite", "cantidad",
        C.timedelta_hms(F.when(F.col("_v") > 0, C.idiv(F.col("_s"), F.col("_v"))), C.NO_DATA).alias("promedio_tiempo"),
        C.timedelta_hms(F.col("_mn"), C.NO_DATA).alias("tiempo_minimo"),
        C.timedelta_hms(F.col("_mx"), C.NO_DATA).alias("tiempo_maximo"),
        "tramites_atipicos")


def cr_relative_outliers(cr_rows: DataFrame, keys=FILE, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """A10: per group count, mean, min, max of minutes and rows above
    factor x mean (a zero mean gives no threshold and no outliers)."""
    p, q = _frac(factor)
    h = F.col("centesimas")
    thr = cr_rows.groupBy(*keys).agg(F.count(h).alias("_n"), F.sum(h).alias("_s"))
    j = attach(cr_rows, thr, keys)
    out = (h * F.col("_n") * q > F.col("_s") * p) & (F.col("_s") != 0)
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entregas"), F.first("_n").alias("_n"), F.first("_s").alias("_s"),
        F.min(h).alias("_mn"), F.max(h).alias("_mx"), F.count_if(out).alias("atipicos"))
    return g.select(
        *keys, "total_entregas",
        C.mean_hundredths_to_hms("_s", "_n", C.ZERO_HMS).alias("promedio_tiempo"),
        C.hundredths_to_hms("_mn", C.ZERO_HMS).alias("tiempo_minimo"),
        C.hundredths_to_hms("_mx", C.ZERO_HMS).alias("tiempo_maximo"),
        "atipicos")


def cr_file_metrics(cr_rows: DataFrame, files: DataFrame, factor: float = OUTLIER_FACTOR) -> DataFrame:
    """A10 for every received file: one without cleaned rows has the zero record
    (no deliveries, no outliers, times of zero). ``files`` holds ``archivo_id``, repeated ids count once."""
    m = cr_relative_outliers(cr_rows, FILE, factor)
    all_files = files.select("archivo_id").distinct().join(m, "archivo_id", "full_outer")
    zero = {"total_entregas": F.lit(0), "atipicos": F.lit(0)} | dict.fromkeys(
        ("promedio_tiempo", "tiempo_minimo", "tiempo_maximo"), F.lit(C.ZERO_HMS))
    return all_files.select("archivo_id", *[F.coalesce(c, zero[c]).alias(c) for c in m.columns if c != "archivo_id"])


def cr_terminal_metrics(cr_rows: DataFrame, keys=FILE) -> DataFrame:
    """Per terminal (null kept as a group): non-null requests, mean / min / max."""
    h = F.col("centesimas")
    g = cr_rows.groupBy(*keys, "terminal").agg(
        F.count("solicitud").alias("entregas"), F.count(h).alias("_n"), F.sum(h).alias("_s"),
        F.min(h).alias("_mn"), F.max(h).alias("_mx"))
    return g.select(
        *keys, "terminal", "entregas",
        C.mean_hundredths_to_hms("_s", "_n", C.ZERO_HMS).alias("promedio_tiempo"),
        C.hundredths_to_hms("_mn", C.ZERO_HMS).alias("tiempo_minimo"),
        C.hundredths_to_hms("_mx", C.ZERO_HMS).alias("tiempo_maximo"))


def type_values(report: DataFrame, type_col: str, n: int = 50) -> DataFrame:
    """The first ``n`` distinct useful values of the type column."""
    v = C.strip(F.col(f"`{type_col}`").cast("string"))
    return (report.select(v.alias("valor")).where(F.col("valor").isNotNull() & (F.col("valor") != ""))
                  .distinct().orderBy("valor").limit(n))
