"""Legacy comparison of a per-clerk SOL report with a per-clerk CR report
(P15-P17, J2, O8, A14): a null-safe full outer join on the clerk name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C

# --- Fixed values: column maps and alias lists of the two report kinds ---
SOL_MAP = {
    "funcionario": "funcionario", "tramites_reales": "sol_tramites", "entregas": "sol_entregas",
    "total_registros": "sol_total", "promedio_general": "sol_promedio_general",
    "promedio_tramites": "sol_promedio_tramites", "promedio_entregas": "sol_promedio_entregas",
    "tiempo_minimo": "sol_minimo", "tiempo_maximo": "sol_maximo", "tramites_atipicos": "sol_atipicos",
    "porcentaje_atipicos": "sol_porcentaje_atipicos", "terminales": "sol_terminales",
}
SOL_NUMERIC = ["sol_tramites", "sol_entregas", "sol_total", "sol_atipicos", "sol_porcentaje_atipicos"]
SOL_TEXT = ["sol_promedio_general", "sol_promedio_tramites", "sol_promedio_entregas", "sol_minimo",
            "sol_maximo", "sol_terminales"]
CR_ALIASES = {
    "cr_cantidad": ["cantidad", "tramites", "total_registros", "entregas"],
    "cr_promedio": ["promedio_tiempo", "promedio_general", "promedio_entregas"],
    "cr_minimo": ["tiempo_minimo"],
    "cr_maximo": ["tiempo_maximo"],
    "cr_atipicos": ["tramites_atipicos", "atipicos"],
}
INT_COLUMNS = ["sol_tramites", "sol_entregas", "sol_total", "sol_atipicos", "cr_cantidad", "cr_atipicos"]
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TEXT_COLUMNS = SOL_TEXT + ["cr_promedio", "cr_minimo", "cr_maximo"]
# ---------------------------------------------------------------------------


def normalize_header(df: DataFrame) -> DataFrame:
    """D5 + S7 header rule: drop repeated names (first occurrence wins), then
    strip + lower-case; a name repeated only after normalising also keeps its
    first occurrence (the reference leaves such columns ambiguous)."""
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    d = df.toDF(*tmp)
    seen, out = set(), {}
    for i, c in enumerate(df.columns):
        if c in seen:
            continue
        seen.add(c)
        n = c.strip().lower()
        if n not in out:
            out[n] = tmp[i]
    return d.select(*[F.col(t).alias(n) for n, t in out.items()])


def to_number(c) -> Column:
    """F16: decimal numeric text (sign, digits, point, exponent) that fits a
    finite double -> double, anything else ('nan', 'inf', '1d', ...) -> 0."""
    text = C.strip(C.col_(c).cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.coalesce(F.when(F.abs(number) < float("inf"), number), F.lit(0.0))


def _empty_as_null(c) -> Column:
    """A CSV round trip reads an empty field as missing."""
    return F.nullif(C.col_(c).cast("string"), F.lit(""))


def sol_report_view(report: DataFrame) -> DataFrame:
    """SOL per-clerk report -> sol_* columns, numbers coerced, texts filled."""
    r = normalize_header(report)
    present = {k: v for k, v in SOL_MAP.items() if k in r.columns}
    cols = []
    for k, v in present.items():
        c = _empty_as_null(k)
        if v in SOL_NUMERIC:
            c = to_number(c)
        elif v in SOL_TEXT:
            c = F.coalesce(c, F.lit(C.NO_DATA))
        cols.append(c.alias(v))
    return r.select(*cols)


def first_present(df: DataFrame, aliases: list[str]) -> Column | None:
    """The first alias that exists among the columns, else None."""
    for a in aliases:
        if a in df.columns:
            return F.col(a)
    return None


def cr_report_view(report: DataFrame) -> DataFrame:
    """CR per-clerk report -> cr_* columns by alias lists; absent -> 0 / 'Sin datos'."""
    r = normalize_header(report)
    out = [F.col("funcionario").cast("string").alias("funcionario")]
    for name, aliases in CR_ALIASES.items():
        src = first_present(r, aliases)
        if name in ("cr_cantidad", "cr_atipicos"):
            out.append((to_number(_empty_as_null(src)) if src is not None else F.lit(0.0)).alias(name))
        else:
            out.append((F.coalesce(_empty_as_null(src), F.lit(C.NO_DATA)) if src is not None
                        else F.lit(C.NO_DATA)).alias(name))
    return r.select(*out)


def merge_reports(sol: DataFrame, cr: DataFrame) -> DataFrame:
    """J2 + P17 + O8: null-safe full outer join on the clerk, derived columns, sorted."""
    s = sol.withColumnRenamed("funcionario", "_fs")
    c = cr.withColumnRenamed("funcionario", "_fc")
    j = s.join(c, s._fs.eqNullSafe(c._fc), "full")
    def have(k, default):
        return F.col(k) if k in j.columns else F.lit(default)
    ints = {k: F.coalesce(have(k, 0).try_cast("bigint"), F.lit(0).cast("bigint")) for k in INT_COLUMNS}     # absent -> 0
    texts = {k: F.coalesce(have(k, C.NO_DATA), F.lit(C.NO_DATA)) for k in TEXT_COLUMNS}  # absent -> 'Sin datos'
    m = j.select(F.coalesce("_fs", "_fc").alias("funcionario"),
                 *[v.alias(k) for k, v in ints.items()], *[v.alias(k) for k, v in texts.items()],
                 F.coalesce(have("sol_porcentaje_atipicos", 0.0), F.lit(0.0)).cast("double")
                  .alias("sol_porcentaje_atipicos"))
    t, e = F.col("sol_tramites"), F.col("cr_cantidad")
    return (m.withColumns({
                "tramites": t, "entregas": e,
                "entregas_por_tramite": F.when(t > 0, C.hundredths_to_double(C.div_half_even(e * 100, t)))
                                         .otherwise(F.lit(0.0)),
                "promedio_tramite": F.col("sol_promedio_tramites"), "promedio_entrega": F.col("cr_promedio"),
                "atipicos_tramite": F.col("sol_atipicos"), "total_operaciones": t + e})
             .orderBy(F.col("total_operaciones").desc(), F.col("tramites").desc(), F.col("entregas").desc(),
                      F.col("funcionario").asc_nulls_last()))


def merge_totals(merged: DataFrame) -> DataFrame:
    """A14 + F15: sums of applications and deliveries, ratio, rows."""
    g = merged.agg(F.sum("tramites").alias("t"), F.sum("entregas").alias("e"), F.count(F.lit(1)).alias("n"))
    t, e = F.coalesce("t", F.lit(0)).cast("bigint"), F.coalesce("e", F.lit(0)).cast("bigint")
    return g.select(t.alias("total_tramites"), e.alias("total_entregas"),
                    C.ratio_text(e, t).alias("relacion_global"), F.col("n").cast("bigint").alias("funcionarios_activos"))
