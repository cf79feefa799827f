"""Dashboard and clerk detail (fixed 15-minute rule).

Batch form of the reference's per-request SQL: every function answers for
all files / offices / clerks at once. Picks (latest file, latest day of a
clerk) are ``min_by`` over a sort-key struct, which aggregates map-side
and so stays skew-safe even when one office holds a third of the rows.
The only ``limit`` is the single-file pick, where top-1 is the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C

SOL_TYPE, CR_TYPE = "TIEMPOS_SOL", "TIEMPOS_CR"
PROCESSED = "PROCESADO"
PERIOD_ORDER = {"DIARIO": 0, "SEMANAL": 1}     # others last
OVER = C.NORM_MINUTES * 100                      # hundredths


def _over(h="centesimas") -> Column:
    return C.col_(h) > OVER


# --- P11 / O1 / W1: which file a dashboard shows ----------------------------

def catalog_filter(catalog: DataFrame, tipo: str, mac: str | None = None, fecha=None) -> DataFrame:
    """Type, processed, active, optional office and business date."""
    cond = (F.col("tipo") == tipo) & (F.col("estatus") == PROCESSED) & (F.col("activo") == F.lit(True))
    if mac:
        cond = cond & (F.col("mac") == mac)
    if fecha:
        cond = cond & (F.col("fecha_operativa") == F.lit(fecha).cast("date"))
    return catalog.where(cond)


def catalog_files(catalog: DataFrame, tipo: str) -> DataFrame:
    """The ids of all files of a type, whatever their state, as ``archivo_id``."""
    return catalog.where(F.col("tipo") == tipo).select(F.col("id").alias("archivo_id"))


def _period_rank() -> Column:
    expr = F.lit(len(PERIOD_ORDER))
    for name, rank in sorted(PERIOD_ORDER.items(), key=lambda kv: -kv[1]):
        expr = F.when(F.col("tipo_periodo") == name, F.lit(rank)).otherwise(expr)
    return expr


def pick_order() -> list[Column]:
    """O1: DIARIO, SEMANAL, others; business date desc, load time desc (nulls last); id desc."""
    return [_period_rank().asc(), F.col("fecha_operativa").desc_nulls_last(),
            F.col("fecha_carga").desc_nulls_last(), F.col("id").desc()]


def pick_key() -> Column:
    """O1 as an ascending struct, for ``min_by``."""
    fo, fc = F.col("fecha_operativa"), F.col("fecha_carga")
    return F.struct(_period_rank().alias("p"), fo.isNull().alias("fo_null"), (-F.unix_date(fo)).alias("fo"),
                    fc.isNull().alias("fc_null"), (-F.unix_micros(fc.cast("timestamp"))).alias("fc"),
                    (-F.col("id")).alias("i"))


CATALOG_PICK_COLUMNS = ["id", "nombre_archivo", "mac", "tipo", "fecha_operativa", "fecha_carga", "tipo_periodo"]


def latest_file(catalog: DataFrame, tipo: str, mac: str | None = None, fecha=None) -> DataFrame:
    """O1: the one file a dashboard reads (0 or 1 row; TakeOrderedAndProject)."""
    return catalog_filter(catalog, tipo, mac, fecha).orderBy(*pick_order()).limit(1).select(*CATALOG_PICK_COLUMNS)


def latest_file_per_office(catalog: DataFrame, tipos=(SOL_TYPE, CR_TYPE), fecha=None) -> DataFrame:
    """The O1 pick for every (type, office) at once, by partial ``min_by``."""
    c = catalog.where(F.col("tipo").isin(list(tipos)) & (F.col("estatus") == PROCESSED)
                      & (F.col("activo") == F.lit(True)))
    if fecha:
        c = c.where(F.col("fecha_operativa") == F.lit(fecha).cast("date"))
    return (c.groupBy("tipo", "mac")
             .agg(F.min_by(F.struct(*CATALOG_PICK_COLUMNS), pick_key()).alias("_p"))
             .select("_p.*"))


# --- A6 / A7: SOL summaries --------------------------------------------------

def file_summary(facts: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """Applications, rounded mean minutes and distinct clerks per group."""
    g = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_tramites"), F.sum("centesimas").alias("_s"),
        F.count("centesimas").alias("_n"), F.count_distinct("funcionario").alias("funcionarios_activos"))
    mean = C.rounded_mean_hundredths("_s", "_n")
    return g.select(*keys, "total_tramites", mean.alias("promedio_centesimas"),
                    C.hundredths_to_hms(mean, C.NO_DATA).alias("promedio_mac"), "funcionarios_activos")


def _clerk_aggs() -> list[Column]:
    term = F.coalesce(F.col("terminal"), F.lit(C.NO_TERMINAL))
    return [F.count(F.lit(1)).alias("tramites"), F.sum("centesimas").alias("_s"),
            F.count("centesimas").alias("_n"), F.min("centesimas").alias("_mn"),
            F.max("centesimas").alias("_mx"), F.count_if(_over()).alias("casos_atipicos"),
            F.array_join(F.array_sort(F.collect_set(term)), ", ").alias("terminales")]


def clerk_ranking(facts: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """A7 + F12 + O2: per clerk (NULL clerk is a group) count, rounded mean,
    count over 15 min, sorted distinct terminals, label and position
    (count desc, clerk asc nulls last) inside each group of ``keys``."""
    from pyspark.sql import Window
    g = facts.groupBy(*keys, "funcionario").agg(*_clerk_aggs())
    mean = C.rounded_mean_hundredths("_s", "_n")
    w = Window.partitionBy(*keys).orderBy(F.col("tramites").desc(), F.col("funcionario").asc_nulls_last())
    return g.select(
        *keys, "funcionario", "tramites", mean.alias("promedio_centesimas"),
        C.hundredths_to_hms(F.coalesce(mean, F.lit(0))).alias("promedio_tiempo"),
        "casos_atipicos", F.coalesce("terminales", F.lit(C.NO_DATA)).alias("terminales"),
        C.performance_label(F.col("tramites"), mean, F.col("casos_atipicos")).alias("desempeno"),
    ).withColumn("posicion", F.row_number().over(w).cast("bigint"))


# --- A8 / A9: CR summaries ---------------------------------------------------

def cr_summary(facts: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """Deliveries, unrounded mean, min, max and count over 15 min in one pass."""
    h = F.col("centesimas")
    g = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_entregas"), F.sum(h).alias("_s"),
                                 F.count(h).alias("_n"), F.min(h).alias("_mn"), F.max(h).alias("_mx"),
                                 F.count_if(_over()).alias("atipicos"))
    return g.select(*keys, "total_entregas",
                    C.mean_hundredths_to_hms("_s", "_n").alias("promedio_tiempo"),
                    C.hundredths_to_hms("_mn").alias("tiempo_minimo"),
                    C.hundredths_to_hms("_mx").alias("tiempo_maximo"), "atipicos")


def cr_by_terminal(facts: DataFrame, keys=("archivo_id",)) -> DataFrame:
    """Per COALESCE(terminal, 'Sin dato'): deliveries, mean, min, max."""
    h = F.col("centesimas")
    t = F.coalesce(F.col("terminal"), F.lit(C.NO_VALUE)).alias("terminal")
    g = facts.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("entregas"), F.sum(h).alias("_s"),
                                    F.count(h).alias("_n"), F.min(h).alias("_mn"), F.max(h).alias("_mx"))
    return g.select(*keys, "terminal", "entregas",
                    C.mean_hundredths_to_hms("_s", "_n").alias("promedio"),
                    C.hundredths_to_hms("_mn").alias("minimo"), C.hundredths_to_hms("_mx").alias("maximo"))


# --- P14 / J8: the dashboard row -----------------------------------------------

def _sol_side(pick: DataFrame, sol_facts: DataFrame, group: list[str], summary=file_summary) -> DataFrame:
    """``summary`` aggregates what ``sol_facts`` holds per file: facts, or their partial states."""
    ids = pick.select(F.col("id").alias("archivo_id"))
    summ = summary(sol_facts.join(ids, "archivo_id", "left_semi"))       # J5-style semi-join
    return pick.join(summ, pick.id == summ.archivo_id, "left").select(
        *group, F.lit(True).alias("_sol"), F.col("id").alias("archivo_id"),
        F.col("nombre_archivo").alias("fuente_sol"), F.col("tipo_periodo").alias("_per_sol"),
        F.col("mac").alias("_mac_sol"), F.col("fecha_operativa").alias("_fecha_sol"),
        "total_tramites", "promedio_mac", "funcionarios_activos")


def _cr_side(pick: DataFrame, cr_facts: DataFrame, group: list[str], summary=cr_summary) -> DataFrame:
    ids = pick.select(F.col("id").alias("archivo_id"))
    summ = summary(cr_facts.join(ids, "archivo_id", "left_semi"))
    return pick.join(summ, pick.id == summ.archivo_id, "left").select(
        *group, F.lit(True).alias("_cr"), F.col("nombre_archivo").alias("fuente_cr"),
        F.col("tipo_periodo").alias("_per_cr"), F.col("mac").alias("_mac_cr"),
        F.col("fecha_operativa").alias("_fecha_cr"), "total_entregas",
        F.col("promedio_tiempo").alias("promedio_entrega"), "tiempo_minimo", "tiempo_maximo",
        F.col("atipicos").alias("atipicos_cr"))


def _assemble(sol: DataFrame, cr: DataFrame, group: list[str]) -> DataFrame:
    """SOL side and CR side, either may be absent, folded into one row per group
    (union + grouped max over at most two rows; no join needed)."""
    both = sol.unionByName(cr, allowMissingColumns=True)
    names = [c for c in both.columns if c not in group]
    keys = [F.col(g) for g in group] or [F.lit(0).alias("_one")]
    f = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])
    has_sol = F.coalesce(F.col("_sol"), F.lit(False))
    tt = F.coalesce(F.col("total_tramites"), F.lit(0)).cast("bigint")
    te = F.coalesce(F.col("total_entregas"), F.lit(0)).cast("bigint")
    return f.select(
        *group, F.col("archivo_id"),
        F.coalesce("fuente_sol", F.lit(C.NO_REPORT)).alias("fuente_sol"),
        F.coalesce("fuente_cr", F.lit(C.NO_REPORT)).alias("fuente_cr"),
        F.coalesce("_per_sol", F.lit(C.NO_VALUE)).alias("tipo_periodo_sol"),
        F.coalesce("_per_cr", F.lit(C.NO_VALUE)).alias("tipo_periodo_cr"),
        F.when(has_sol, F.col("_mac_sol")).otherwise(F.col("_mac_cr")).alias("mac_archivo"),
        F.when(has_sol, F.col("_fecha_sol")).otherwise(F.col("_fecha_cr")).alias("fecha_operativa"),
        tt.alias("total_tramites"), te.alias("total_entregas"),
        C.ratio_text(te, tt).alias("relacion_global"),
        F.coalesce("promedio_mac", F.lit(C.NO_DATA)).alias("promedio_mac"),
        F.coalesce("funcionarios_activos", F.lit(0)).cast("bigint").alias("funcionarios_activos"),
        F.coalesce("promedio_entrega", F.lit(C.NO_DATA)).alias("promedio_entrega"),
        F.coalesce("tiempo_minimo", F.lit(C.NO_DATA)).alias("tiempo_minimo"),
        F.coalesce("tiempo_maximo", F.lit(C.NO_DATA)).alias("tiempo_maximo"),
        F.coalesce("atipicos_cr", F.lit(0)).cast("bigint").alias("atipicos_cr"))


def dashboard(catalog: DataFrame, sol_facts: DataFrame, cr_facts: DataFrame,
              mac: str | None = None, fecha=None) -> DataFrame:
    """The dashboard row for one scope (0 rows when neither file exists).
    Both picks are at most one row (``limit 1``), so broadcasting them is bounded."""
    sol = _sol_side(F.broadcast(latest_file(catalog, SOL_TYPE, mac, fecha)), sol_facts, [])
    cr = _cr_side(F.broadcast(latest_file(catalog, CR_TYPE, mac, fecha)), cr_facts, [])
    return _assemble(sol, cr, [])


def dashboard_by_office(catalog: DataFrame, sol_facts: DataFrame, cr_facts: DataFrame,
                        fecha=None) -> DataFrame:
    """P14 for every office at once: W1 picks, then the same assembly per office."""
    picks = latest_file_per_office(catalog, fecha=fecha).withColumn("oficina", F.col("mac"))
    sol = _sol_side(picks.where(F.col("tipo") == SOL_TYPE), sol_facts, ["oficina"])
    cr = _cr_side(picks.where(F.col("tipo") == CR_TYPE), cr_facts, ["oficina"])
    return _assemble(sol, cr, ["oficina"])


# --- A12 / O3 / J5 / O4 / A13 / P12 / P19: clerk detail ---------------------------

def _clerk_scope(facts: DataFrame, nombre=None, mac=None, fecha=None) -> DataFrame:
    """P12 base predicate: a named clerk (NULL clerks never match), optional office / date."""
    cond = F.col("funcionario").isNotNull()
    if nombre is not None:
        cond = cond & (F.col("funcionario") == nombre)
    if mac:
        cond = cond & (F.col("mac") == mac)
    if fecha:
        cond = cond & (F.col("fecha") == F.lit(fecha).cast("date"))
    return facts.where(cond)


def clerk_latest_summary(facts: DataFrame, nombre=None, mac=None, fecha=None) -> DataFrame:
    """A12 + O3: per clerk, the (office, date) group with the latest date
    (ties: office asc) and its count, rounded mean, min, max, count > 15, terminals."""
    f = _clerk_scope(facts, nombre, mac, fecha)
    g = f.groupBy("funcionario", "mac", "fecha").agg(*_clerk_aggs())
    mean = C.rounded_mean_hundredths("_s", "_n")
    row = g.select(
        "funcionario", "mac", "fecha", F.col("tramites").alias("total_tramites"),
        C.hundredths_to_hms(mean).alias("promedio_tiempo"),
        C.hundredths_to_hms("_mn").alias("tiempo_minimo"), C.hundredths_to_hms("_mx").alias("tiempo_maximo"),
        F.col("casos_atipicos").alias("mayores_15"),
        F.coalesce("terminales", F.lit(C.NO_DATA)).alias("terminales"))
    key = F.struct(F.col("fecha").isNotNull().alias("nn"), (-F.unix_date("fecha")).alias("d"), F.col("mac").alias("m"))
    return (row.groupBy("funcionario").agg(F.min_by(F.struct(*row.columns), key).alias("_r"))
               .select("_r.*"))


def _latest_groups(facts, nombre, mac, fecha) -> DataFrame:
    return clerk_latest_summary(facts, nombre, mac, fecha).select("funcionario", "mac", "fecha")


def clerk_detail(facts: DataFrame, nombre=None, mac=None, fecha=None, tipo=None) -> DataFrame:
    """J5 + P12 + O4 + P19: the application rows of each clerk's latest
    (office, date), optional category filter, presentation texts."""
    f = _clerk_scope(facts, nombre, mac, fecha)
    if tipo:
        f = f.where(F.coalesce("categoria", F.lit(C.NO_VALUE)) == tipo)
    d = f.join(_latest_groups(facts, nombre, mac, fecha), ["funcionario", "mac", "fecha"], "inner")
    return d.select(
        "funcionario", "mac", "fecha", "row_no",
        F.coalesce("folio", F.lit(C.NO_VALUE)).alias("folio_tramite"),
        F.coalesce("tipo_tramite", F.lit(C.NO_VALUE)).alias("tipo_tramite"),
        F.coalesce("categoria", F.lit(C.NO_VALUE)).alias("tipo_tramite_categoria"),
        C.time_of_day_text("hora_inicio").alias("hora_inicio"),
        C.time_of_day_text("hora_fin").alias("hora_fin"),
        C.hundredths_to_hms("centesimas").alias("tiempo_atencion"),
        F.coalesce("terminal", F.lit(C.NO_VALUE)).alias("terminal"),
        F.coalesce("domicilio_visible", F.lit(C.NO_VALUE)).alias("domicilio_visible"),
        F.coalesce("estatus_tramite", F.lit(C.NO_VALUE)).alias("estatus_tramite"),
        F.col("hora_inicio").alias("_hi"),
    ).orderBy("funcionario", F.col("_hi").asc_nulls_last(), "row_no").drop("_hi")


def clerk_type_summary(facts: DataFrame, nombre=None, mac=None, fecha=None) -> DataFrame:
    """Per clerk at the latest (office, date), by COALESCE(category, 'Sin dato')."""
    f = _clerk_scope(facts, nombre, mac, fecha)
    d = f.join(_latest_groups(facts, nombre, mac, fecha), ["funcionario", "mac", "fecha"], "inner")
    cat = F.coalesce(F.col("categoria"), F.lit(C.NO_VALUE)).alias("tipo_tramite_categoria")
    g = d.groupBy("funcionario", cat).agg(
        F.count(F.lit(1)).alias("total"), F.sum("centesimas").alias("_s"), F.count("centesimas").alias("_n"),
        F.min("centesimas").alias("_mn"), F.max("centesimas").alias("_mx"),
        F.count_if(_over()).alias("mayores_15"))
    return g.select("funcionario", "tipo_tramite_categoria", "total",
                    C.hundredths_to_hms(C.rounded_mean_hundredths("_s", "_n")).alias("promedio_tiempo"),
                    C.hundredths_to_hms("_mn").alias("tiempo_minimo"),
                    C.hundredths_to_hms("_mx").alias("tiempo_maximo"), "mayores_15")


# --- J1 / J3 -------------------------------------------------------------------

def split_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference's two tables (applications, attention times) from the wide fact."""
    tr = facts.select(F.col("row_no").alias("id"), "archivo_id", "mac", "fecha", "folio", "tipo_tramite",
                      "categoria", "funcionario", "terminal", "domicilio_visible", "estatus_tramite")
    ti = facts.select(F.col("archivo_id").alias("_archivo"), F.col("row_no").alias("tramite_id"), "hora_inicio", "hora_fin", "centesimas", "dentro_norma")
    return tr, ti


def join_times(tramites: DataFrame, tiempos: DataFrame) -> DataFrame:
    """Applications joined 1:1 with their attention times on file and row (row
    numbers start anew in every file)."""
    same = (tramites.archivo_id == tiempos._archivo) & (tramites.id == tiempos.tramite_id)
    return tramites.join(tiempos, same, "inner").drop("_archivo", "tramite_id")


def user_roster(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their role name, by user id. The role dimension is not
    hinted: Spark broadcasts it when its measured size is under the threshold."""
    r = roles.select(F.col("id").alias("_rid"), F.col("nombre").alias("rol"))
    return (users.join(r, users.role_id == r._rid, "inner").drop("_rid").orderBy("id"))


def scope_of(role_id: Column, mac_asignado: Column) -> Column:
    """Role 1 sees every office; others their own; no office -> nothing (fail closed)."""
    return F.when(role_id == 1, F.lit("*")).when(mac_asignado.isNull(), F.lit(None).cast("string")).otherwise(mac_asignado)


def scoped_counts(users: DataFrame, facts: DataFrame) -> DataFrame:
    """P13 applied: rows each user may see (per-office counts, then a small join)."""
    # one pass: the scope '*' is the grand total of the per-office counts
    counts = facts.rollup("mac").agg(F.count(F.lit(1)).alias("filas"), F.grouping("mac").alias("_all")).select(
        F.when(F.col("_all") == 1, F.lit("*")).otherwise(F.col("mac")).alias("_scope"), "filas")
    u = users.select("id", "username", "role_id", scope_of(F.col("role_id"), F.col("mac_asignado")).alias("alcance"))
    return (u.join(counts, u.alcance == counts._scope, "left")
             .select("id", "username", "alcance", F.coalesce("filas", F.lit(0)).cast("bigint").alias("filas_visibles")))


def _scope(users: DataFrame, username: str) -> Column:
    """P13 of one user as a scalar subquery: '*', an office, or null for nothing (also an unknown user)."""
    one = users.where(F.col("username") == username)
    return one.agg(F.min(scope_of(F.col("role_id"), F.col("mac_asignado")))).scalar()


def scoped_rows(rows: DataFrame, users: DataFrame, username: str) -> DataFrame:
    """The rows (of facts or of the catalog) that a user may see. The scope is a
    one-row subquery inside the filter, so an administrator's rows are neither copied nor joined."""
    scope = _scope(users, username)
    return rows.where((scope == "*") | (F.col("mac") == scope))


def latest_scoped_rows(facts: DataFrame, catalog: DataFrame, users: DataFrame, username: str, tipo: str = SOL_TYPE) -> DataFrame:
    """P13 in "latest" mode: the fact rows of the O1 pick among the files that a user may see."""
    pick = latest_file(scoped_rows(catalog, users, username), tipo)
    return facts.join(pick.select(F.col("id").alias("archivo_id")), "archivo_id", "left_semi")
