"""Independent SQL (DuckDB dialect) for every registered query.

Written from the rules, not from the Spark code: stand-ins are rebuilt from
the base tables, dedup uses ``row_number()`` windows, thresholds use plain
joins. Column names and types match the Spark results (BIGINT / VARCHAR /
DATE / DOUBLE / BOOLEAN only).
"""

from __future__ import annotations

from ventanilla.sources.reports import CR_LAYOUT, SOL_LAYOUT
from ventanilla.sources.standins import SOL_HEADERS

# ---- scalar macros ----------------------------------------------------------


def half_even(a: str, b: str) -> str:
    q = f"(({a}) // ({b}))"
    r = f"(({a}) % ({b}))"
    return f"(CASE WHEN 2 * {r} > ({b}) THEN {q} + 1 WHEN 2 * {r} = ({b}) THEN {q} + {q} % 2 ELSE {q} END)"


def half_up(a: str, b: str) -> str:
    return f"((2 * ({a}) + ({b})) // (2 * ({b})))"


def hms(s: str) -> str:
    return f"printf('%02d:%02d:%02d', ({s}) // 3600, (({s}) % 3600) // 60, ({s}) % 60)"


def hms_h(h: str, null_text: str = "Sin datos") -> str:
    return f"(CASE WHEN ({h}) IS NULL THEN '{null_text}' ELSE {hms(half_even(f'3 * ({h})', '5'))} END)"


def mean_hms(s: str, n: str, null_text: str = "Sin datos") -> str:
    return (f"(CASE WHEN ({s}) IS NULL OR ({n}) = 0 THEN '{null_text}' "
            f"ELSE {hms(half_even(f'3 * ({s})', f'5 * ({n})'))} END)")


def round_mean(s: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN CAST({half_up(s, n)} AS BIGINT) END)"


def td_hms(us: str, null_text: str = "") -> str:
    return f"(CASE WHEN ({us}) IS NULL THEN '{null_text}' ELSE {hms(f'(({us}) // 1000000) % 86400')} END)"


def pct_double(x: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN CAST({half_even(f'({x}) * 10000', n)} AS DOUBLE) / 100.0 ELSE 0.0 END)"


def fixed2(h: str) -> str:
    return f"concat(({h}) // 100, '.', lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0'))"


def ratio_text(e: str, t: str) -> str:
    return f"(CASE WHEN ({t}) > 0 THEN {fixed2(half_even(f'({e}) * 100', t))} ELSE '0.00' END)"


def py_number(h: str) -> str:
    return (f"(CASE WHEN ({h}) % 100 = 0 THEN concat(({h}) // 100, '.0') "
            f"WHEN ({h}) % 10 = 0 THEN concat(({h}) // 100, '.', (({h}) % 100) // 10) "
            f"ELSE concat(({h}) // 100, '.', lpad(CAST(({h}) % 100 AS VARCHAR), 2, '0')) END)")


def label(n: str, m: str, o: str) -> str:
    return (f"(CASE WHEN {n} < 10 THEN 'Bajo volumen' "
            f"WHEN coalesce({m}, 0) <= 1300 AND {o} * 100 <= {n} * 20 THEN 'Alto' "
            f"WHEN coalesce({m}, 0) <= 1500 AND {o} * 100 <= {n} * 35 THEN 'Medio' ELSE 'Bajo' END)")


def category(t: str) -> str:
    u = f"upper(trim({t}))"
    return (f"(CASE WHEN {t} IS NULL OR {u} IN ('', 'NAN') THEN 'SIN_CLASIFICAR' "
            f"WHEN {u} LIKE '%ENTREGA%' THEN 'ENTREGA' WHEN {u} LIKE '%INSCRIP%' THEN 'INSCRIPCION' "
            f"WHEN {u} LIKE '%REPOS%' THEN 'REPOSICION' WHEN {u} LIKE '%DOMIC%' THEN 'CAMBIO_DOMICILIO' "
            f"WHEN {u} LIKE '%CORREC%' THEN 'CORRECCION_DATOS' WHEN {u} LIKE '%REINCORP%' THEN 'REINCORPORACION' "
            f"WHEN {u} LIKE '%REEMPLAZO%' THEN 'REEMPLAZO' ELSE 'TRAMITE' END)")


def office(n: str) -> str:
    return (f"(CASE WHEN strpos({n}, '090852') > 0 THEN '090852' "
            f"WHEN strpos({n}, '090853') > 0 THEN '090853' ELSE 'DESCONOCIDO' END)")


def report_type(n: str) -> str:
    u = f"upper({n})"
    return (f"(CASE WHEN strpos({u}, 'TIEMATEN_SOL') > 0 OR strpos({u}, '_SOL_') > 0 THEN 'TIEMPOS_SOL' "
            f"WHEN strpos({u}, 'TIEMATEN_CR') > 0 OR strpos({u}, '_CR_') > 0 THEN 'TIEMPOS_CR' "
            f"WHEN strpos({u}, 'TIEM') > 0 OR strpos({u}, 'ATEN') > 0 THEN 'TIEMPOS' "
            f"WHEN strpos({u}, 'TRAM') > 0 THEN 'TRAMITES' WHEN strpos({u}, 'INVE') > 0 THEN 'INVENTARIO' "
            f"ELSE 'OTRO' END)")


def hms_text(s: str) -> str:
    """H:MM:SS with unpadded hours (stand-in cell text)."""
    return f"concat(({s}) // 3600, ':', lpad(CAST((({s}) % 3600) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(({s}) % 60 AS VARCHAR), 2, '0'))"


P10 = ("length(funcionario_txt) > 0 AND upper(funcionario_txt) <> 'NOMBRE FUNCIONARIO' "
       "AND lower(funcionario_txt) <> 'nan'")
PICK_ORDER = ("CASE tipo_periodo WHEN 'DIARIO' THEN 0 WHEN 'SEMANAL' THEN 1 ELSE 2 END, "
              "fecha_operativa DESC NULLS LAST, fecha_carga DESC NULLS LAST, id DESC")
TERMS = "string_agg(DISTINCT coalesce(terminal, 'Sin terminal'), ', ' ORDER BY coalesce(terminal, 'Sin terminal'))"

# ---- stand-in and pipeline CTEs ---------------------------------------------

SOL = f"""
sol_raw AS (
  SELECT CAST(2 * (CASE WHEN day(ts) <= 20 THEN day(ts) ELSE 100 + day(ts) // 7 END) + user_id % 2 AS BIGINT) AS archivo_id,
         CASE WHEN user_id % 2 = 0 THEN '090852' ELSE '090853' END AS mac,
         event_id AS row_no, ts,
         CASE WHEN event_id % 1009 = 0 THEN 'TERMINAL' WHEN event_id % 29 = 0 THEN NULL
              WHEN event_id % 7 = 0 THEN ' ' ELSE concat('CLIENTE ', event_id % 6 + 1) END AS terminal_txt,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('S', event_id % 5) END AS folio,
         CASE WHEN event_id % 997 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS fecha,
         CASE event_type WHEN 'purchase' THEN ' Entrega de credencial ' WHEN 'signup' THEN 'Inscripción'
              WHEN 'view' THEN 'Reposición' WHEN 'click' THEN 'Cambio de domicilio' END AS tipo_txt,
         CASE WHEN user_id % 50 = 49 THEN NULL WHEN user_id % 50 = 48 THEN 'nan' ELSE concat('F', user_id) END AS clerk_txt,
         CASE WHEN user_id % 3 = 0 THEN 'SI' WHEN user_id % 3 = 1 THEN 'NO' END AS domicilio_visible,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 15) AS BIGINT) END AS segundos
  FROM events),
sol_rows AS (
  SELECT archivo_id, concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '.xls') AS nombre_archivo, mac, row_no, fecha, folio,
         CASE WHEN tipo_txt IS NULL OR trim(tipo_txt) = '' OR lower(trim(tipo_txt)) = 'nan' THEN NULL ELSE trim(tipo_txt) END AS tipo_tramite,
         {category('tipo_txt')} AS categoria,
         CASE WHEN clerk_txt IS NULL OR trim(clerk_txt) = '' OR lower(trim(clerk_txt)) = 'nan' THEN NULL ELSE trim(clerk_txt) END AS funcionario,
         CASE WHEN trim(terminal_txt) = '' OR lower(trim(terminal_txt)) = 'nan' THEN NULL ELSE trim(terminal_txt) END AS terminal,
         domicilio_visible,
         CASE WHEN fecha IS NULL THEN NULL ELSE date_trunc('second', ts) END AS hora_inicio,
         CASE WHEN fecha IS NULL OR segundos IS NULL THEN NULL ELSE strftime(ts + to_seconds(segundos), '%H:%M:%S') END AS hora_fin_txt,
         segundos * 1000000 AS duracion_us,
         (10 * segundos + 3) // 6 AS centesimas,
         terminal_txt,
         trim(coalesce(clerk_txt, 'nan')) AS funcionario_txt
  FROM sol_raw
  WHERE terminal_txt IS NOT NULL AND upper(trim(terminal_txt)) <> 'TERMINAL'),
sol_kept AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY archivo_id, coalesce(folio, ''), coalesce(funcionario, ''),
                                 coalesce(terminal, '') ORDER BY row_no) AS rn
    FROM sol_rows) WHERE rn = 1),
sol_facts AS (
  SELECT * FROM sol_kept WHERE archivo_id NOT IN (SELECT archivo_id FROM sol_kept WHERE fecha IS NULL))"""

CR = f"""
cr_raw AS (
  SELECT CAST(1000 + l_suppkey % 40 AS BIGINT) AS archivo_id,
         CASE WHEN l_suppkey % 2 = 0 THEN '090852' ELSE '090853' END AS mac,
         l_orderkey * 10 + l_linenumber AS row_no,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE concat('CLIENTE ', l_suppkey % 6 + 1) END AS terminal,
         CASE WHEN l_orderkey % 101 = 0 THEN 'nan' ELSE CAST(l_orderkey // 20 AS VARCHAR) END AS solicitud,
         CAST(l_shipdate AS DATE) AS fecha_entrega,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(trunc(l_quantity * 30) AS BIGINT) END AS segundos
  FROM lineitem),
cr_clean AS (
  SELECT archivo_id, concat('Rep_TiemAten_CR_', mac, '_', archivo_id, '.xls') AS nombre_archivo, mac, row_no,
         terminal, solicitud, fecha_entrega, segundos * 1000000 AS duracion_us, (10 * segundos + 3) // 6 AS centesimas
  FROM cr_raw WHERE terminal IS NOT NULL AND segundos IS NOT NULL),
cr_fact_rows AS (SELECT * FROM cr_clean WHERE lower(solicitud) <> 'nan'),
cr_kept AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY archivo_id, solicitud, terminal, fecha_entrega ORDER BY row_no) AS rn
    FROM cr_fact_rows) WHERE rn = 1),
cr_facts AS (SELECT * FROM cr_kept)"""

CATALOG = """
cat AS (
  SELECT o_orderkey AS id,
         concat('Rep_TiemAten_', CASE o_orderstatus WHEN 'F' THEN 'SOL_' WHEN 'O' THEN 'CR_' ELSE 'X_' END,
                CASE WHEN o_custkey % 3 = 0 THEN '090852' WHEN o_custkey % 3 = 1 THEN '090853' ELSE '000000' END,
                '_', o_orderkey, '.xls') AS nombre_archivo,
         CASE WHEN o_custkey % 3 = 0 THEN '090852' WHEN o_custkey % 3 = 1 THEN '090853' ELSE 'DESCONOCIDO' END AS mac,
         CASE o_orderstatus WHEN 'F' THEN 'TIEMPOS_SOL' WHEN 'O' THEN 'TIEMPOS_CR' ELSE 'TIEMPOS' END AS tipo,
         CASE WHEN o_orderkey % 10 = 0 THEN 'ERROR' WHEN o_orderkey % 10 = 1 THEN 'PENDIENTE' ELSE 'PROCESADO' END AS estatus,
         o_orderkey % 23 <> 0 AS activo,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha_operativa,
         o_orderdate AS fecha_carga,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DIARIO' WHEN '2' THEN 'SEMANAL' END AS tipo_periodo
  FROM orders)"""

LEDGER = f"""
sol_files AS (SELECT archivo_id, any_value(mac) AS mac, concat('Rep_TiemAten_SOL_', any_value(mac), '_', archivo_id, '.xls') AS nombre_archivo
              FROM sol_raw GROUP BY archivo_id),
sol_roll AS (SELECT archivo_id, count(*) AS filas_limpias, min(fecha) AS fi, max(fecha) AS ff FROM sol_rows GROUP BY archivo_id),
sol_gate AS (SELECT archivo_id, count(*) AS conservadas, count(*) FILTER (WHERE fecha IS NULL) AS viol FROM sol_kept GROUP BY archivo_id),
sol_clerks AS (SELECT archivo_id, count(*) AS nf FROM sol_rows WHERE {P10} GROUP BY archivo_id),
sol_state AS (
  SELECT f.archivo_id AS id, f.nombre_archivo, f.mac, 'TIEMPOS_SOL' AS tipo,
         CASE WHEN coalesce(r.filas_limpias, 0) = 0 THEN 'El archivo quedó sin registros después de la limpieza'
              WHEN coalesce(g.viol, 0) > 0 THEN 'null value in column "fecha" violates not-null constraint'
              WHEN coalesce(c.nf, 0) = 0 THEN 'No se generó ranking por funcionario' END AS mensaje_error,
         r.fi, r.ff, g.conservadas
  FROM sol_files f LEFT JOIN sol_roll r USING (archivo_id) LEFT JOIN sol_gate g USING (archivo_id)
       LEFT JOIN sol_clerks c USING (archivo_id)),
cr_files AS (SELECT archivo_id, any_value(mac) AS mac, concat('Rep_TiemAten_CR_', any_value(mac), '_', archivo_id, '.xls') AS nombre_archivo
             FROM cr_raw GROUP BY archivo_id),
cr_roll AS (SELECT archivo_id, count(*) AS filas_limpias, min(fecha_entrega) AS fi, max(fecha_entrega) AS ff FROM cr_clean GROUP BY archivo_id),
cr_gate AS (SELECT archivo_id, count(*) AS conservadas, count(*) FILTER (WHERE fecha_entrega IS NULL) AS viol FROM cr_kept GROUP BY archivo_id),
cr_state AS (
  SELECT f.archivo_id AS id, f.nombre_archivo, f.mac, 'TIEMPOS_CR' AS tipo,
         CASE WHEN coalesce(r.filas_limpias, 0) = 0 THEN 'El archivo CR quedó sin registros después de la limpieza'
              WHEN coalesce(g.viol, 0) > 0 THEN 'null value in column "fecha_entrega" violates not-null constraint' END AS mensaje_error,
         r.fi, r.ff, g.conservadas
  FROM cr_files f LEFT JOIN cr_roll r USING (archivo_id) LEFT JOIN cr_gate g USING (archivo_id)),
icat AS (
  SELECT id, nombre_archivo, mac, tipo,
         CASE WHEN mensaje_error IS NULL THEN 'PROCESADO' ELSE 'ERROR' END AS estatus, mensaje_error, TRUE AS activo,
         CASE WHEN mensaje_error IS NULL THEN ff END AS fecha_operativa,
         CASE WHEN mensaje_error IS NULL THEN fi END AS fecha_inicio,
         CASE WHEN mensaje_error IS NULL THEN ff END AS fecha_fin,
         CASE WHEN mensaje_error IS NULL THEN (CASE WHEN fi <> ff THEN 'SEMANAL' ELSE 'DIARIO' END) END AS tipo_periodo,
         CAST(CASE WHEN mensaje_error IS NULL THEN conservadas ELSE 0 END AS BIGINT) AS registros_insertados,
         CAST(NULL AS TIMESTAMP) AS fecha_carga
  FROM (SELECT * FROM sol_state UNION ALL SELECT * FROM cr_state))"""

# the upload of every report file, the gate's verdict on it, and the catalog of the accepted ones
UPLOADS = """
ups AS (SELECT DISTINCT archivo_id, mac, 'TIEMPOS_SOL' AS tipo, concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '.xls') AS nombre_archivo FROM sol_raw
        UNION SELECT DISTINCT archivo_id, mac, 'TIEMPOS_CR', concat('Rep_TiemAten_CR_', mac, '_', archivo_id, '.xls') FROM cr_raw),
gated AS (
  SELECT *, CASE WHEN esperado <> tipo THEN 'tipo_distinto' WHEN archivo_id % 4 <> 0 AND oficina IS NULL THEN 'usuario_sin_mac'
                 WHEN archivo_id % 4 <> 0 AND mac <> oficina THEN 'mac_ajeno' END AS motivo
  FROM (SELECT *, CASE WHEN archivo_id % 3 = 0 THEN NULL WHEN archivo_id % 13 = 0 THEN 'TIEMPOS_CR' ELSE tipo END AS esperado,
               CASE WHEN archivo_id % 9 = 0 THEN NULL WHEN archivo_id % 11 = 0 THEN '090852' ELSE mac END AS oficina,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(archivo_id * 37 % 1000) AS carga FROM ups)),
scat AS (SELECT icat.* EXCLUDE (fecha_carga), g.carga AS fecha_carga FROM icat
         JOIN gated g ON g.archivo_id = icat.id AND g.tipo = icat.tipo WHERE g.motivo IS NULL)"""


def w(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _clerk_metric_sql(keys: list[str], src: str = "sol_rows") -> str:
    """CTEs thr, r, terms, tl, g for the A4 metrics grouped by ``keys``."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = f"USING ({k})" if keys else "ON TRUE"
    return f"""
thr AS (SELECT {kc}count(duracion_us) AS nv, sum(duracion_us) AS sv, count(*) AS total FROM {src} {'GROUP BY ' + k if keys else ''}),
r AS (SELECT s.*, coalesce(s.duracion_us * t.nv * 2 > t.sv * 3, FALSE) AS outl
      FROM {src} s JOIN thr t {on} WHERE {P10}),
terms AS (SELECT {kc}funcionario_txt, trim(terminal_txt) AS term, min(row_no) AS fr FROM r
          WHERE terminal_txt IS NOT NULL GROUP BY ALL),
tl AS (SELECT {kc}funcionario_txt, string_agg(term, ', ' ORDER BY fr) AS terminales FROM terms GROUP BY ALL),
g AS (SELECT {kc}funcionario_txt, count(*) AS total_registros,
             count(*) FILTER (WHERE categoria = 'ENTREGA') AS entregas,
             count(duracion_us) AS v, sum(duracion_us) AS s, min(duracion_us) AS mn, max(duracion_us) AS mx,
             count(duracion_us) FILTER (WHERE categoria = 'ENTREGA') AS v_ent,
             sum(duracion_us) FILTER (WHERE categoria = 'ENTREGA') AS s_ent,
             count(duracion_us) FILTER (WHERE categoria <> 'ENTREGA') AS v_tr,
             sum(duracion_us) FILTER (WHERE categoria <> 'ENTREGA') AS s_tr,
             count(*) FILTER (WHERE outl AND duracion_us IS NOT NULL) AS atip
      FROM r GROUP BY ALL),
cm AS (SELECT {', '.join('g.' + x for x in keys) + ', ' if keys else ''}g.funcionario_txt AS funcionario,
              total_registros, entregas, total_registros - entregas AS tramites_reales,
              CAST(CASE WHEN v > 0 THEN s // v END AS BIGINT) AS promedio_general_us,
              CAST(CASE WHEN v_ent > 0 THEN s_ent // v_ent END AS BIGINT) AS promedio_entregas_us,
              CAST(CASE WHEN v_tr > 0 THEN s_tr // v_tr END AS BIGINT) AS promedio_tramites_us,
              mn AS tiempo_minimo_us, mx AS tiempo_maximo_us, atip AS tramites_atipicos,
              {pct_double('atip', 'total_registros')} AS porcentaje_atipicos,
              coalesce(tl.terminales, 'Sin dato') AS terminales
       FROM g LEFT JOIN tl ON g.funcionario_txt = tl.funcionario_txt {''.join(f' AND g.{x} = tl.{x}' for x in keys)})"""


def _export_sql(keys: list[str]) -> str:
    k = ", ".join(f"cm.{x}" for x in keys)
    join = ("JOIN thr t USING (" + ", ".join(keys) + ")") if keys else "JOIN thr t ON TRUE"
    return f"""
ex AS (SELECT {k + ', ' if keys else ''}funcionario, tramites_reales, entregas, cm.total_registros,
              concat({py_number(half_even('tramites_reales * 10000', 't.total'))}, '%') AS porcentaje_tramites,
              {td_hms('promedio_general_us')} AS promedio_general, {td_hms('promedio_tramites_us')} AS promedio_tramites,
              {td_hms('promedio_entregas_us')} AS promedio_entregas, {td_hms('tiempo_minimo_us')} AS tiempo_minimo,
              {td_hms('tiempo_maximo_us')} AS tiempo_maximo, tramites_atipicos, porcentaje_atipicos, terminales
       FROM cm {join})"""


def _ranking(keys: list[str]) -> str:
    k = ", ".join(keys)
    return w(SOL, f"""
g AS (SELECT {k}, funcionario, count(*) AS tramites, sum(centesimas) AS s, count(centesimas) AS n,
             count(*) FILTER (WHERE centesimas > 1500) AS casos_atipicos, {TERMS} AS terminales
      FROM sol_facts GROUP BY ALL),
m AS (SELECT *, {round_mean('s', 'n')} AS promedio_centesimas FROM g)""") + f"""
SELECT {k}, funcionario, tramites, promedio_centesimas, {hms_h('coalesce(promedio_centesimas, 0)')} AS promedio_tiempo,
       casos_atipicos, terminales, {label('tramites', 'promedio_centesimas', 'casos_atipicos')} AS desempeno,
       row_number() OVER (PARTITION BY {k} ORDER BY tramites DESC, funcionario ASC NULLS LAST) AS posicion
FROM m"""


LATEST_GROUP = f"""
lg AS (SELECT funcionario, mac, fecha, count(*) AS total_tramites, sum(centesimas) AS s, count(centesimas) AS n,
              min(centesimas) AS mn, max(centesimas) AS mx, count(*) FILTER (WHERE centesimas > 1500) AS mayores_15,
              {TERMS} AS terminales
       FROM sol_facts WHERE funcionario IS NOT NULL GROUP BY ALL),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY funcionario ORDER BY fecha DESC NULLS FIRST, mac) AS rn FROM lg)
       WHERE rn = 1)"""


def _dashboard_side_sql() -> str:
    return f"""
sp AS (SELECT * FROM icat WHERE tipo = 'TIEMPOS_SOL' AND estatus = 'PROCESADO' AND activo ORDER BY {PICK_ORDER} LIMIT 1),
cp AS (SELECT * FROM icat WHERE tipo = 'TIEMPOS_CR' AND estatus = 'PROCESADO' AND activo ORDER BY {PICK_ORDER} LIMIT 1),
ss AS (SELECT count(*) AS tt, sum(centesimas) AS s, count(centesimas) AS n, count(DISTINCT funcionario) AS fa
       FROM sol_facts WHERE archivo_id IN (SELECT id FROM sp)),
cs AS (SELECT count(*) AS te, sum(centesimas) AS s, count(centesimas) AS n, min(centesimas) AS mn, max(centesimas) AS mx,
              count(*) FILTER (WHERE centesimas > 1500) AS atip
       FROM cr_facts WHERE archivo_id IN (SELECT id FROM cp))"""


def queries_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clerk_ranking"] = _ranking(["archivo_id"])
    q["clerk_day_ranking"] = _ranking(["mac", "fecha"])
    q["file_summary"] = w(SOL, """
g AS (SELECT archivo_id, count(*) AS total_tramites, sum(centesimas) AS s, count(centesimas) AS n,
             count(DISTINCT funcionario) AS funcionarios_activos FROM sol_facts GROUP BY archivo_id)""") + f"""
SELECT archivo_id, total_tramites, {round_mean('s', 'n')} AS promedio_centesimas,
       {hms_h(round_mean('s', 'n'))} AS promedio_mac, funcionarios_activos FROM g"""
    q["latest_file_per_office"] = w(CATALOG) + f"""
SELECT id, nombre_archivo, mac, tipo, fecha_operativa, tipo_periodo FROM (
  SELECT *, row_number() OVER (PARTITION BY tipo, mac ORDER BY {PICK_ORDER}) AS rn FROM cat
  WHERE tipo IN ('TIEMPOS_SOL', 'TIEMPOS_CR') AND estatus = 'PROCESADO' AND activo) WHERE rn = 1"""
    q["latest_file"] = w(CATALOG) + f"""
SELECT * FROM (SELECT id, nombre_archivo, mac, tipo, fecha_operativa, tipo_periodo FROM cat
               WHERE tipo = 'TIEMPOS_SOL' AND estatus = 'PROCESADO' AND activo AND mac = '090852'
               ORDER BY {PICK_ORDER} LIMIT 1)
UNION ALL
SELECT * FROM (SELECT id, nombre_archivo, mac, tipo, fecha_operativa, tipo_periodo FROM cat
               WHERE tipo = 'TIEMPOS_CR' AND estatus = 'PROCESADO' AND activo AND mac = '090852'
               ORDER BY {PICK_ORDER} LIMIT 1)"""
    q["cr_summary"] = w(CR, """
g AS (SELECT archivo_id, count(*) AS total_entregas, sum(centesimas) AS s, count(centesimas) AS n,
             min(centesimas) AS mn, max(centesimas) AS mx, count(*) FILTER (WHERE centesimas > 1500) AS atipicos
      FROM cr_facts GROUP BY archivo_id)""") + f"""
SELECT archivo_id, total_entregas, {mean_hms('s', 'n')} AS promedio_tiempo, {hms_h('mn')} AS tiempo_minimo,
       {hms_h('mx')} AS tiempo_maximo, atipicos FROM g"""
    q["cr_by_terminal"] = w(CR, """
g AS (SELECT archivo_id, coalesce(terminal, 'Sin dato') AS terminal, count(*) AS entregas, sum(centesimas) AS s,
             count(centesimas) AS n, min(centesimas) AS mn, max(centesimas) AS mx FROM cr_facts GROUP BY ALL)""") + f"""
SELECT archivo_id, terminal, entregas, {mean_hms('s', 'n')} AS promedio, {hms_h('mn')} AS minimo, {hms_h('mx')} AS maximo,
       row_number() OVER (PARTITION BY archivo_id ORDER BY entregas DESC, terminal) AS posicion FROM g"""
    q["cr_relative_outliers"] = w(CR, """
t AS (SELECT archivo_id, count(centesimas) AS n, sum(centesimas) AS s FROM cr_clean GROUP BY archivo_id),
g AS (SELECT c.archivo_id, count(*) AS total_entregas, any_value(t.n) AS n, any_value(t.s) AS s,
             min(c.centesimas) AS mn, max(c.centesimas) AS mx,
             count(*) FILTER (WHERE c.centesimas * t.n * 2 > t.s * 3 AND t.s <> 0) AS atipicos
      FROM cr_clean c JOIN t USING (archivo_id) GROUP BY c.archivo_id)""") + f"""
SELECT archivo_id, total_entregas, {mean_hms('s', 'n', '00:00:00')} AS promedio_tiempo,
       {hms_h('mn', '00:00:00')} AS tiempo_minimo, {hms_h('mx', '00:00:00')} AS tiempo_maximo, atipicos FROM g"""
    q["cr_terminal_metrics"] = w(CR, """
g AS (SELECT archivo_id, terminal, count(solicitud) AS entregas, sum(centesimas) AS s, count(centesimas) AS n,
             min(centesimas) AS mn, max(centesimas) AS mx FROM cr_clean GROUP BY ALL)""") + f"""
SELECT archivo_id, terminal, entregas, {mean_hms('s', 'n', '00:00:00')} AS promedio_tiempo,
       {hms_h('mn', '00:00:00')} AS tiempo_minimo, {hms_h('mx', '00:00:00')} AS tiempo_maximo,
       row_number() OVER (PARTITION BY archivo_id ORDER BY entregas DESC, terminal NULLS LAST) AS posicion FROM g"""
    q["dashboard_row"] = w(SOL, CR, LEDGER, _dashboard_side_sql()) + f"""
SELECT (SELECT id FROM sp) AS archivo_id,
       coalesce((SELECT nombre_archivo FROM sp), 'Sin reporte') AS fuente_sol,
       coalesce((SELECT nombre_archivo FROM cp), 'Sin reporte') AS fuente_cr,
       coalesce((SELECT tipo_periodo FROM sp), 'Sin dato') AS tipo_periodo_sol,
       coalesce((SELECT tipo_periodo FROM cp), 'Sin dato') AS tipo_periodo_cr,
       CASE WHEN EXISTS (SELECT 1 FROM sp) THEN (SELECT mac FROM sp) ELSE (SELECT mac FROM cp) END AS mac_archivo,
       CASE WHEN EXISTS (SELECT 1 FROM sp) THEN (SELECT fecha_operativa FROM sp) ELSE (SELECT fecha_operativa FROM cp) END AS fecha_operativa,
       ss.tt AS total_tramites, cs.te AS total_entregas, {ratio_text('cs.te', 'ss.tt')} AS relacion_global,
       {hms_h(round_mean('ss.s', 'ss.n'))} AS promedio_mac, ss.fa AS funcionarios_activos,
       {mean_hms('cs.s', 'cs.n')} AS promedio_entrega, {hms_h('cs.mn')} AS tiempo_minimo, {hms_h('cs.mx')} AS tiempo_maximo,
       cs.atip AS atipicos_cr
FROM ss, cs
WHERE EXISTS (SELECT 1 FROM sp) OR EXISTS (SELECT 1 FROM cp)"""
    q["dashboard_by_office"] = w(SOL, CR, LEDGER, f"""
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tipo, mac ORDER BY {PICK_ORDER}) AS rn FROM icat
          WHERE tipo IN ('TIEMPOS_SOL', 'TIEMPOS_CR') AND estatus = 'PROCESADO' AND activo) WHERE rn = 1),
sp AS (SELECT * FROM picks WHERE tipo = 'TIEMPOS_SOL'),
cp AS (SELECT * FROM picks WHERE tipo = 'TIEMPOS_CR'),
ss AS (SELECT archivo_id, count(*) AS tt, sum(centesimas) AS s, count(centesimas) AS n, count(DISTINCT funcionario) AS fa
       FROM sol_facts WHERE archivo_id IN (SELECT id FROM sp) GROUP BY archivo_id),
cs AS (SELECT archivo_id, count(*) AS te, sum(centesimas) AS s, count(centesimas) AS n, min(centesimas) AS mn,
              max(centesimas) AS mx, count(*) FILTER (WHERE centesimas > 1500) AS atip
       FROM cr_facts WHERE archivo_id IN (SELECT id FROM cp) GROUP BY archivo_id),
offices AS (SELECT mac FROM sp UNION SELECT mac FROM cp)""") + f"""
SELECT o.mac AS oficina, sp.id AS archivo_id, coalesce(sp.nombre_archivo, 'Sin reporte') AS fuente_sol,
       coalesce(cp.nombre_archivo, 'Sin reporte') AS fuente_cr, coalesce(sp.tipo_periodo, 'Sin dato') AS tipo_periodo_sol,
       coalesce(cp.tipo_periodo, 'Sin dato') AS tipo_periodo_cr,
       CASE WHEN sp.id IS NOT NULL THEN sp.mac ELSE cp.mac END AS mac_archivo,
       CASE WHEN sp.id IS NOT NULL THEN sp.fecha_operativa ELSE cp.fecha_operativa END AS fecha_operativa,
       coalesce(ss.tt, 0) AS total_tramites, coalesce(cs.te, 0) AS total_entregas,
       {ratio_text('coalesce(cs.te, 0)', 'coalesce(ss.tt, 0)')} AS relacion_global,
       {hms_h(round_mean('ss.s', 'ss.n'))} AS promedio_mac, coalesce(ss.fa, 0) AS funcionarios_activos,
       {mean_hms('cs.s', 'cs.n')} AS promedio_entrega, {hms_h('cs.mn')} AS tiempo_minimo, {hms_h('cs.mx')} AS tiempo_maximo,
       coalesce(cs.atip, 0) AS atipicos_cr
FROM offices o LEFT JOIN sp ON sp.mac = o.mac LEFT JOIN cp ON cp.mac = o.mac
     LEFT JOIN ss ON ss.archivo_id = sp.id LEFT JOIN cs ON cs.archivo_id = cp.id"""
    q["clerk_detail"] = w(SOL, LATEST_GROUP) + f"""
SELECT f.funcionario, f.mac, f.fecha, f.row_no, coalesce(f.folio, 'Sin dato') AS folio_tramite,
       coalesce(f.tipo_tramite, 'Sin dato') AS tipo_tramite, coalesce(f.categoria, 'Sin dato') AS tipo_tramite_categoria,
       coalesce(strftime(f.hora_inicio, '%H:%M:%S'), 'Sin dato') AS hora_inicio, coalesce(f.hora_fin_txt, 'Sin dato') AS hora_fin,
       {hms_h('f.centesimas')} AS tiempo_atencion, coalesce(f.terminal, 'Sin dato') AS terminal,
       coalesce(f.domicilio_visible, 'Sin dato') AS domicilio_visible, 'Sin dato' AS estatus_tramite
FROM sol_facts f JOIN lr USING (funcionario, mac, fecha)"""
    q["clerk_latest_summary"] = w(SOL, LATEST_GROUP) + f"""
SELECT funcionario, mac, fecha, total_tramites, {hms_h(round_mean('s', 'n'))} AS promedio_tiempo,
       {hms_h('mn')} AS tiempo_minimo, {hms_h('mx')} AS tiempo_maximo, mayores_15, terminales FROM lr"""
    q["clerk_type_summary"] = w(SOL, LATEST_GROUP, """
tg AS (SELECT f.funcionario, coalesce(f.categoria, 'Sin dato') AS tipo_tramite_categoria, count(*) AS total,
              sum(f.centesimas) AS s, count(f.centesimas) AS n, min(f.centesimas) AS mn, max(f.centesimas) AS mx,
              count(*) FILTER (WHERE f.centesimas > 1500) AS mayores_15
       FROM sol_facts f JOIN lr USING (funcionario, mac, fecha) GROUP BY ALL)""") + f"""
SELECT funcionario, tipo_tramite_categoria, total, {hms_h(round_mean('s', 'n'))} AS promedio_tiempo,
       {hms_h('mn')} AS tiempo_minimo, {hms_h('mx')} AS tiempo_maximo, mayores_15,
       row_number() OVER (PARTITION BY funcionario ORDER BY total DESC, tipo_tramite_categoria) AS posicion FROM tg"""
    q["terminal_share"] = w(SOL, """
per AS (SELECT archivo_id, terminal_txt AS terminal, count(*) AS registros FROM sol_rows GROUP BY ALL),
tot AS (SELECT archivo_id, count(*) AS total FROM sol_rows GROUP BY ALL)""") + f"""
SELECT archivo_id, terminal, registros, {pct_double('registros', 'total')} AS porcentaje FROM per JOIN tot USING (archivo_id)"""
    q["category_counts"] = w(SOL) + "\nSELECT archivo_id, categoria, count(*) AS cantidad FROM sol_rows GROUP BY ALL"
    q["clerk_metrics"] = w(SOL, _clerk_metric_sql(["archivo_id"])) + """
SELECT *, row_number() OVER (PARTITION BY archivo_id ORDER BY total_registros DESC, funcionario) AS posicion FROM cm"""
    q["clerk_category_metrics"] = w(SOL, f"""
thr AS (SELECT archivo_id, count(duracion_us) AS nv, sum(duracion_us) AS sv FROM sol_rows GROUP BY archivo_id),
r AS (SELECT s.*, coalesce(s.duracion_us * t.nv * 2 > t.sv * 3, FALSE) AS outl FROM sol_rows s JOIN thr t USING (archivo_id)
      WHERE {P10}),
g AS (SELECT archivo_id, funcionario_txt AS funcionario, categoria AS tipo_tramite, count(*) AS cantidad,
             count(duracion_us) AS v, sum(duracion_us) AS s, min(duracion_us) AS mn, max(duracion_us) AS mx,
             count(*) FILTER (WHERE outl AND duracion_us IS NOT NULL) AS tramites_atipicos FROM r GROUP BY ALL)""") + f"""
SELECT archivo_id, funcionario, tipo_tramite, cantidad,
       {td_hms('CASE WHEN v > 0 THEN s // v END', 'Sin datos')} AS promedio_tiempo,
       {td_hms('mn', 'Sin datos')} AS tiempo_minimo, {td_hms('mx', 'Sin datos')} AS tiempo_maximo, tramites_atipicos,
       row_number() OVER (PARTITION BY archivo_id ORDER BY funcionario, cantidad DESC, tipo_tramite NULLS LAST) AS posicion FROM g"""
    q["global_threshold"] = w(SOL, """
g AS (SELECT archivo_id, count(*) AS total_registros, count(duracion_us) AS nv, sum(duracion_us) AS sv
      FROM sol_rows GROUP BY archivo_id)""") + f"""
SELECT archivo_id, total_registros, nv AS registros_validos,
       CAST(CASE WHEN nv > 0 THEN sv // nv END AS BIGINT) AS promedio_us,
       CAST(CASE WHEN nv > 0 THEN (sv * 3) // (nv * 2) END AS BIGINT) AS umbral_us,
       CASE WHEN nv > 0 THEN {hms('sv // (nv * 1000000)')} ELSE 'Sin datos válidos' END AS promedio_tiempo,
       CASE WHEN nv > 0 THEN {hms('(sv * 3) // (nv * 2 * 1000000)')} ELSE 'Sin datos válidos' END AS umbral_atipico,
       CASE WHEN nv > 0 THEN 'Tiempo mayor a 1.5 veces el promedio general' ELSE 'Sin datos válidos' END AS criterio_atipico
FROM g"""
    q["sol_dedup"] = w(SOL) + "\nSELECT archivo_id, row_no, folio, funcionario, terminal, fecha FROM sol_kept"
    q["cr_dedup"] = w(CR) + "\nSELECT archivo_id, row_no, solicitud, terminal, fecha_entrega FROM cr_kept"
    q["file_rollup"] = w(SOL, CR) + """
SELECT archivo_id, count(*) AS filas_limpias, min(fecha) AS fecha_inicio, max(fecha) AS fecha_fin,
       max(fecha) AS fecha_operativa, CASE WHEN min(fecha) <> max(fecha) THEN 'SEMANAL' ELSE 'DIARIO' END AS tipo_periodo,
       'TIEMPOS_SOL' AS tipo FROM sol_rows GROUP BY archivo_id
UNION ALL
SELECT archivo_id, count(*), min(fecha_entrega), max(fecha_entrega), max(fecha_entrega),
       CASE WHEN min(fecha_entrega) <> max(fecha_entrega) THEN 'SEMANAL' ELSE 'DIARIO' END, 'TIEMPOS_CR'
FROM cr_clean GROUP BY archivo_id"""
    q["file_gate"] = w(SOL) + """
SELECT archivo_id, count(*) AS filas_conservadas, count(*) FILTER (WHERE fecha IS NULL) AS violaciones,
       count(*) FILTER (WHERE fecha IS NULL) = 0 AS aceptado FROM sol_kept GROUP BY archivo_id"""
    q["ledger_latest"] = w(SOL, CR, LEDGER) + "\nSELECT * EXCLUDE (fecha_carga) FROM icat"
    sol_rules = {"mac_fuera_de_catalogo": "mac NOT IN ('090852', '090853')", "fecha_nula": "fecha IS NULL",
                 "minutos_fuera_de_rango": "abs(centesimas) >= 10000000000",
                 "folio_mayor_a_50": "length(folio) > 50", "tipo_tramite_mayor_a_100": "length(tipo_tramite) > 100",
                 "categoria_mayor_a_100": "length(categoria) > 100", "funcionario_mayor_a_150": "length(funcionario) > 150",
                 "terminal_mayor_a_50": "length(terminal) > 50", "domicilio_visible_mayor_a_20": "length(domicilio_visible) > 20",
                 "nombre_archivo_mayor_a_255": "length(nombre_archivo) > 255"}
    cr_rules = {"mac_fuera_de_catalogo": "mac NOT IN ('090852', '090853')", "fecha_entrega_nula": "fecha_entrega IS NULL",
                "minutos_fuera_de_rango": "abs(centesimas) >= 10000000000",
                "solicitud_mayor_a_50": "length(solicitud) > 50", "folio_nec_mayor_a_50": "length(concat('NEC', row_no // 10)) > 50",
                "terminal_mayor_a_50": "length(terminal) > 50", "nombre_archivo_mayor_a_255": "length(nombre_archivo) > 255"}
    parts = [f"SELECT 'tramites' AS tabla, '{k}' AS regla, count(*) FILTER (WHERE {v}) AS filas FROM sol_kept"
             for k, v in sol_rules.items()]
    parts += [f"SELECT 'entregas_cr', '{k}', count(*) FILTER (WHERE {v}) FROM cr_kept" for k, v in cr_rules.items()]
    q["quality_counts"] = w(SOL, CR) + "\n" + "\nUNION ALL ".join(parts)
    q["orphans"] = w(SOL, CR) + """
SELECT 'tramites->archivos' AS relacion, count(*) AS filas,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.archivo_id)) AS huerfanos
FROM sol_facts f
UNION ALL
SELECT 'entregas->archivos', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.archivo_id)) FROM cr_facts f
UNION ALL
SELECT 'usuarios->roles', count(*),
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey)) FROM supplier s"""
    q["unique_violations"] = w(CATALOG) + """
SELECT 'roles.nombre' AS clave, n_name AS valor, count(*) AS repeticiones FROM nation GROUP BY n_name HAVING count(*) > 1
UNION ALL
SELECT 'usuarios.username', s_name, count(*) FROM supplier GROUP BY s_name HAVING count(*) > 1
UNION ALL
SELECT 'archivos.nombre_archivo', nombre_archivo, count(*) FROM cat GROUP BY nombre_archivo HAVING count(*) > 1"""
    merge = w(SOL, _clerk_metric_sql([]), _export_sql([]), f"""
sol AS (SELECT funcionario,
               coalesce(TRY_CAST(trim(CAST(tramites_reales AS VARCHAR)) AS DOUBLE), 0.0) AS sol_tramites,
               coalesce(TRY_CAST(trim(CAST(entregas AS VARCHAR)) AS DOUBLE), 0.0) AS sol_entregas,
               coalesce(TRY_CAST(trim(CAST(total_registros AS VARCHAR)) AS DOUBLE), 0.0) AS sol_total,
               coalesce(nullif(promedio_general, ''), 'Sin datos') AS sol_promedio_general,
               coalesce(nullif(promedio_tramites, ''), 'Sin datos') AS sol_promedio_tramites,
               coalesce(nullif(promedio_entregas, ''), 'Sin datos') AS sol_promedio_entregas,
               coalesce(nullif(tiempo_minimo, ''), 'Sin datos') AS sol_minimo,
               coalesce(nullif(tiempo_maximo, ''), 'Sin datos') AS sol_maximo,
               coalesce(TRY_CAST(trim(CAST(tramites_atipicos AS VARCHAR)) AS DOUBLE), 0.0) AS sol_atipicos,
               porcentaje_atipicos AS sol_porcentaje_atipicos,
               coalesce(nullif(terminales, ''), 'Sin datos') AS sol_terminales
        FROM ex),
crr AS (SELECT CASE WHEN s_suppkey % 50 = 49 THEN NULL ELSE concat('F', s_suppkey) END AS funcionario,
               CASE WHEN s_suppkey % 13 = 0 THEN 'n/a' ELSE CAST((s_suppkey * 7) % 40 AS VARCHAR) END AS entregas,
               CASE WHEN (s_suppkey * 7) % 40 = 0 THEN NULL ELSE {hms_text('s_suppkey * 11 % 1800')} END AS promedio_tiempo,
               {hms_text('s_suppkey % 300')} AS tiempo_minimo, {hms_text('s_suppkey % 300 + 900')} AS tiempo_maximo,
               CAST(s_suppkey % 4 AS VARCHAR) AS atipicos
        FROM supplier),
cr AS (SELECT funcionario, coalesce(TRY_CAST(trim(entregas) AS DOUBLE), 0.0) AS cr_cantidad,
              coalesce(promedio_tiempo, 'Sin datos') AS cr_promedio, coalesce(tiempo_minimo, 'Sin datos') AS cr_minimo,
              coalesce(tiempo_maximo, 'Sin datos') AS cr_maximo, coalesce(TRY_CAST(trim(atipicos) AS DOUBLE), 0.0) AS cr_atipicos
       FROM crr),
mg AS (SELECT coalesce(sol.funcionario, cr.funcionario) AS funcionario,
              CAST(trunc(coalesce(sol_tramites, 0)) AS BIGINT) AS sol_tramites,
              CAST(trunc(coalesce(sol_entregas, 0)) AS BIGINT) AS sol_entregas,
              CAST(trunc(coalesce(sol_total, 0)) AS BIGINT) AS sol_total,
              CAST(trunc(coalesce(sol_atipicos, 0)) AS BIGINT) AS sol_atipicos,
              CAST(trunc(coalesce(cr_cantidad, 0)) AS BIGINT) AS cr_cantidad,
              CAST(trunc(coalesce(cr_atipicos, 0)) AS BIGINT) AS cr_atipicos,
              coalesce(sol_promedio_general, 'Sin datos') AS sol_promedio_general,
              coalesce(sol_promedio_tramites, 'Sin datos') AS sol_promedio_tramites,
              coalesce(sol_promedio_entregas, 'Sin datos') AS sol_promedio_entregas,
              coalesce(sol_minimo, 'Sin datos') AS sol_minimo, coalesce(sol_maximo, 'Sin datos') AS sol_maximo,
              coalesce(sol_terminales, 'Sin datos') AS sol_terminales, coalesce(cr_promedio, 'Sin datos') AS cr_promedio,
              coalesce(cr_minimo, 'Sin datos') AS cr_minimo, coalesce(cr_maximo, 'Sin datos') AS cr_maximo,
              coalesce(sol_porcentaje_atipicos, 0.0) AS sol_porcentaje_atipicos
       FROM sol FULL OUTER JOIN cr ON sol.funcionario IS NOT DISTINCT FROM cr.funcionario),
merged AS (SELECT *, sol_tramites AS tramites, cr_cantidad AS entregas,
                  CASE WHEN sol_tramites > 0 THEN CAST({half_even('cr_cantidad * 100', 'sol_tramites')} AS DOUBLE) / 100.0
                       ELSE 0.0 END AS entregas_por_tramite,
                  sol_promedio_tramites AS promedio_tramite, cr_promedio AS promedio_entrega,
                  sol_atipicos AS atipicos_tramite, sol_tramites + cr_cantidad AS total_operaciones FROM mg)""")
    q["report_merge"] = merge + "\nSELECT * FROM merged"
    q["merge_totals"] = merge + f"""
SELECT CAST(coalesce(sum(tramites), 0) AS BIGINT) AS total_tramites, CAST(coalesce(sum(entregas), 0) AS BIGINT) AS total_entregas,
       {ratio_text('coalesce(sum(entregas), 0)', 'coalesce(sum(tramites), 0)')} AS relacion_global,
       count(*) AS funcionarios_activos FROM merged"""
    q["export_rows"] = w(SOL, _clerk_metric_sql(["archivo_id"]), _export_sql(["archivo_id"])) + "\nSELECT * FROM ex"
    q["user_roster"] = """
SELECT s_suppkey AS id, s_name AS username, concat('Usuario ', s_suppkey) AS nombre_completo,
       CAST(s_nationkey AS BIGINT) AS role_id, s_suppkey % 9 <> 0 AS activo,
       CASE WHEN s_suppkey % 3 = 0 THEN '090852' WHEN s_suppkey % 3 = 1 THEN '090853' END AS mac_asignado,
       n_name AS rol
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
    q["classify_names"] = w(CATALOG) + f"""
SELECT id, nombre_archivo, {office('nombre_archivo')} AS mac_detectado, {report_type('nombre_archivo')} AS tipo_detectado FROM cat"""
    q["category_of_text"] = w(SOL) + f"""
SELECT tipo_txt AS tipo_texto, {category('tipo_txt')} AS categoria, count(*) AS filas FROM sol_raw GROUP BY ALL"""
    q["new_rows_only"] = w(SOL) + """
SELECT k.archivo_id, k.row_no, k.folio, k.funcionario, k.terminal FROM sol_kept k
WHERE NOT EXISTS (SELECT 1 FROM sol_facts f WHERE f.archivo_id = k.archivo_id AND coalesce(f.folio, '') = coalesce(k.folio, '')
                  AND coalesce(f.funcionario, '') = coalesce(k.funcionario, '') AND coalesce(f.terminal, '') = coalesce(k.terminal, ''))"""
    q["type_values_top50"] = w(SOL) + """
SELECT DISTINCT trim(tipo_txt) AS valor FROM sol_raw
WHERE terminal_txt IS NOT NULL AND upper(trim(terminal_txt)) <> 'TERMINAL' AND tipo_txt IS NOT NULL AND trim(tipo_txt) <> ''
ORDER BY valor LIMIT 50"""
    q["scoped_facts"] = w(SOL, """
u AS (SELECT s_suppkey AS id, s_name AS username,
             CASE WHEN s_nationkey = 1 THEN '*' WHEN s_suppkey % 3 = 0 THEN '090852' WHEN s_suppkey % 3 = 1 THEN '090853' END AS alcance
      FROM supplier),
c AS (SELECT mac AS alcance, count(*) AS filas FROM sol_facts GROUP BY mac UNION ALL SELECT '*', count(*) FROM sol_facts)""") + """
SELECT u.id, u.username, u.alcance, CAST(coalesce(c.filas, 0) AS BIGINT) AS filas_visibles FROM u LEFT JOIN c USING (alcance)"""
    user = """
u AS (SELECT CASE WHEN s_nationkey = 1 THEN '*' WHEN s_suppkey % 3 = 0 THEN '090852' WHEN s_suppkey % 3 = 1 THEN '090853' END AS alcance
      FROM supplier WHERE s_name = 'Supplier#000000004')"""
    seen = "SELECT archivo_id, row_no, mac, fecha, funcionario, centesimas FROM sol_facts"
    q["scoped_rows"] = w(SOL, user) + f"""
{seen} WHERE EXISTS (SELECT 1 FROM u WHERE alcance = '*' OR alcance = mac)"""
    q["scoped_latest_rows"] = w(SOL, CR, LEDGER, user) + f"""
{seen} WHERE archivo_id IN (SELECT id FROM icat JOIN u ON alcance = '*' OR alcance = icat.mac
  WHERE tipo = 'TIEMPOS_SOL' AND estatus = 'PROCESADO' AND activo ORDER BY {PICK_ORDER} LIMIT 1)"""
    q["clerk_detail_for"] = w(SOL, """
lr AS (SELECT funcionario, max(fecha) AS fecha FROM sol_facts WHERE mac = '090853' GROUP BY funcionario)""") + f"""
SELECT f.funcionario, f.mac, f.fecha, f.row_no, coalesce(f.folio, 'Sin dato') AS folio_tramite,
       coalesce(f.tipo_tramite, 'Sin dato') AS tipo_tramite, coalesce(f.categoria, 'Sin dato') AS tipo_tramite_categoria,
       coalesce(strftime(f.hora_inicio, '%H:%M:%S'), 'Sin dato') AS hora_inicio, coalesce(f.hora_fin_txt, 'Sin dato') AS hora_fin,
       {hms_h('f.centesimas')} AS tiempo_atencion, coalesce(f.terminal, 'Sin dato') AS terminal,
       coalesce(f.domicilio_visible, 'Sin dato') AS domicilio_visible, 'Sin dato' AS estatus_tramite
FROM sol_facts f JOIN lr USING (funcionario, fecha) WHERE f.mac = '090853' AND f.categoria = 'ENTREGA'"""
    q["cr_file_metrics"] = w(CATALOG, q["cr_relative_outliers"].removeprefix("WITH").rsplit("\nSELECT archivo_id, total_entregas", 1)[0]) + f"""
SELECT coalesce(g.archivo_id, f.archivo_id) AS archivo_id, coalesce(total_entregas, 0) AS total_entregas,
       coalesce({mean_hms('s', 'n', '00:00:00')}, '00:00:00') AS promedio_tiempo,
       coalesce({hms_h('mn', '00:00:00')}, '00:00:00') AS tiempo_minimo, coalesce({hms_h('mx', '00:00:00')}, '00:00:00') AS tiempo_maximo,
       coalesce(atipicos, 0) AS atipicos
FROM g FULL JOIN (SELECT id AS archivo_id FROM cat WHERE tipo = 'TIEMPOS_CR') f ON f.archivo_id = g.archivo_id"""
    q["upload_gate"] = w(CATALOG, f"""
up AS (SELECT c.id, c.nombre_archivo, o.o_custkey % 5 AS role_id,
              CASE WHEN o.o_custkey % 7 = 0 THEN NULL WHEN o.o_custkey % 2 = 0 THEN '090852' ELSE '090853' END AS mac_usuario,
              CASE WHEN c.id % 3 = 0 THEN NULL WHEN c.id % 3 = 1 THEN 'TIEMPOS_SOL' ELSE 'TIEMPOS_CR' END AS tipo_esperado,
              {office('c.nombre_archivo')} AS mac, {report_type('c.nombre_archivo')} AS tipo
       FROM cat c JOIN orders o ON o.o_orderkey = c.id),
rs AS (SELECT *, CASE WHEN tipo_esperado IS NOT NULL AND tipo <> tipo_esperado THEN 'tipo_distinto'
                      WHEN role_id <> 1 AND mac = 'DESCONOCIDO' THEN 'mac_desconocido'
                      WHEN role_id <> 1 AND mac_usuario IS NULL THEN 'usuario_sin_mac'
                      WHEN role_id <> 1 AND mac <> mac_usuario THEN 'mac_ajeno' END AS motivo FROM up)""") + """
SELECT id, mac, tipo, motivo IS NULL AS aceptado, coalesce(motivo, '') AS motivo FROM rs"""
    q["tramite_time_join"] = w(SOL) + """
SELECT t.row_no AS id, t.archivo_id, t.funcionario, m.centesimas, m.centesimas <= 1500 AS dentro_norma
FROM (SELECT archivo_id, row_no, funcionario FROM sol_facts) t
JOIN (SELECT archivo_id, row_no, centesimas FROM sol_facts) m ON t.archivo_id = m.archivo_id AND t.row_no = m.row_no"""
    # in a file, rows are numbered from below the title and the two header rows
    sheet = f"row_no + {SOL_LAYOUT['header_row'] + 2} AS row_no"
    q["report_file_ingest"] = w(SOL) + f"""
SELECT nombre_archivo, mac, {sheet}, fecha, folio, categoria, funcionario, terminal, centesimas FROM sol_rows"""
    q["sheet_file_ingest"] = w(SOL) + f"""
SELECT replace(nombre_archivo, '.xls', '.xlsx') AS nombre_archivo, mac, {sheet}, fecha, folio, categoria, funcionario, terminal, centesimas
FROM sol_rows"""
    # three rows of a report are its title and its two header rows
    q["sheet_probe"] = w(SOL) + f"""
SELECT concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '.xlsx') AS nombre_archivo, count(*) + 3 AS filas, {len(SOL_HEADERS)} AS columnas
FROM sol_raw GROUP BY archivo_id, mac"""
    q["sheet_stream_ingest"] = w(CR) + f"""
SELECT replace(nombre_archivo, '.xls', '.xlsx') AS nombre_archivo, mac, row_no + {CR_LAYOUT['header_row'] + 2} AS row_no, fecha_entrega,
       solicitud, terminal, centesimas FROM cr_clean"""
    q["report_files"] = w(SOL, _clerk_metric_sql(["archivo_id"]), _export_sql(["archivo_id"])) + """
SELECT concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '_reporte_funcionarios.csv') AS archivo, ex.* EXCLUDE (archivo_id)
FROM ex JOIN (SELECT DISTINCT archivo_id, mac FROM sol_rows) USING (archivo_id)"""
    q["terminal_files"] = w(SOL, """
per AS (SELECT archivo_id, mac, terminal_txt AS terminal, count(*) AS registros FROM sol_rows GROUP BY ALL),
tot AS (SELECT archivo_id, count(*) AS total FROM sol_rows GROUP BY ALL)""") + f"""
SELECT concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '_metricas.csv') AS archivo, terminal, registros,
       {pct_double('registros', 'total')} AS porcentaje FROM per JOIN tot USING (archivo_id)"""
    # which files deviate and how: see the queries' landing folder
    q["sol_file_ingest"] = w(SOL) + f"""
SELECT nombre_archivo, mac, {sheet}, fecha, folio, categoria, funcionario, terminal, centesimas
FROM sol_rows WHERE archivo_id % 10 NOT IN (5, 7)
UNION ALL
SELECT concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '.xls'), mac, {sheet}, fecha, folio, {category('tipo_txt')},
       CASE WHEN clerk_txt IS NULL OR trim(clerk_txt) = '' OR lower(trim(clerk_txt)) = 'nan' THEN NULL ELSE trim(clerk_txt) END,
       NULL, (10 * segundos + 3) // 6 FROM sol_raw WHERE archivo_id % 10 = 5"""
    q["cr_file_ingest"] = w(CR) + f"""
SELECT nombre_archivo, mac, row_no + {CR_LAYOUT['header_row'] + 2} AS row_no, fecha_entrega, solicitud, terminal, centesimas
FROM cr_clean WHERE archivo_id % 10 NOT IN (4, 6)"""
    q["stream_cr_ingest"] = w(CR) + f"""
SELECT nombre_archivo, mac, row_no + {CR_LAYOUT['header_row'] + 2} AS row_no, fecha_entrega, solicitud, terminal, centesimas FROM cr_facts"""
    q["file_errors"] = w(SOL, CR) + """
SELECT DISTINCT concat('Rep_TiemAten_SOL_', mac, '_', archivo_id, '.xls') AS nombre_archivo, mac, 'TIEMPOS_SOL' AS tipo,
       'Sin renglones de encabezado' AS motivo FROM sol_raw WHERE archivo_id % 10 = 7
UNION ALL
SELECT DISTINCT concat('Rep_TiemAten_CR_', mac, '_', archivo_id, '.xls'), mac, 'TIEMPOS_CR',
       CASE WHEN archivo_id % 10 = 4 THEN 'Faltan columnas clave en CR: tiempo_total_atencion' ELSE 'Sin renglones de datos' END
FROM cr_raw WHERE archivo_id % 10 IN (4, 6)"""
    q["store_catalog"] = w(SOL, CR, LEDGER, UPLOADS) + """
SELECT * REPLACE (strftime(fecha_carga, '%Y-%m-%d %H:%M:%S') AS fecha_carga) FROM scat"""
    q["store_then_dashboard"] = w(SOL, CR, LEDGER, UPLOADS, f"""
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tipo, alcance ORDER BY {PICK_ORDER}) AS rn
                         FROM (SELECT *, unnest([mac, '*']) AS alcance FROM scat) WHERE estatus = 'PROCESADO' AND activo) WHERE rn = 1),
sp AS (SELECT p.*, f.tt, f.s, f.n, f.fa FROM picks p JOIN (
         SELECT archivo_id, count(*) AS tt, sum(centesimas) AS s, count(centesimas) AS n, count(DISTINCT funcionario) AS fa
         FROM sol_facts GROUP BY archivo_id) f ON f.archivo_id = p.id WHERE p.tipo = 'TIEMPOS_SOL'),
cp AS (SELECT p.*, f.te, f.s, f.n, f.mn, f.mx, f.atip FROM picks p JOIN (
         SELECT archivo_id, count(*) AS te, sum(centesimas) AS s, count(centesimas) AS n, min(centesimas) AS mn, max(centesimas) AS mx,
                count(*) FILTER (WHERE centesimas > 1500) AS atip FROM cr_facts GROUP BY archivo_id) f ON f.archivo_id = p.id WHERE p.tipo = 'TIEMPOS_CR'),
u AS (SELECT s_suppkey AS id, s_name AS username,
             CASE WHEN s_nationkey = 1 THEN '*' WHEN s_suppkey % 3 = 0 THEN '090852' WHEN s_suppkey % 3 = 1 THEN '090853' END AS alcance FROM supplier)""") + f"""
SELECT u.id, u.username, u.alcance, sp.id AS archivo_id,
       coalesce(sp.nombre_archivo, 'Sin reporte') AS fuente_sol, coalesce(cp.nombre_archivo, 'Sin reporte') AS fuente_cr,
       coalesce(sp.tipo_periodo, 'Sin dato') AS tipo_periodo_sol, coalesce(cp.tipo_periodo, 'Sin dato') AS tipo_periodo_cr,
       coalesce(sp.mac, cp.mac, 'Sin datos') AS mac_archivo,
       coalesce(CAST(CASE WHEN sp.id IS NULL THEN cp.fecha_operativa ELSE sp.fecha_operativa END AS VARCHAR), 'Sin datos') AS fecha_operativa,
       {ratio_text('coalesce(cp.te, 0)', 'coalesce(sp.tt, 0)')} AS relacion_global, {hms_h(round_mean('sp.s', 'sp.n'))} AS promedio_mac,
       {mean_hms('cp.s', 'cp.n')} AS promedio_entrega, {hms_h('cp.mn')} AS tiempo_minimo, {hms_h('cp.mx')} AS tiempo_maximo,
       coalesce(sp.tt, 0) AS total_tramites, coalesce(cp.te, 0) AS total_entregas, coalesce(sp.fa, 0) AS funcionarios_activos,
       coalesce(cp.atip, 0) AS atipicos_cr
FROM u LEFT JOIN sp ON sp.alcance = u.alcance LEFT JOIN cp ON cp.alcance = u.alcance"""
    # files without a TERMINAL column keep their header row; those without a type header take the other name for it
    fate = """
bare AS (SELECT archivo_id, count(*) FILTER (WHERE fecha IS NULL) AS sin_fecha, count(*) AS filas, min(fmin) AS primera, max(fmax) AS ultima FROM (
           SELECT *, min(fecha) OVER (PARTITION BY archivo_id) AS fmin, max(fecha) OVER (PARTITION BY archivo_id) AS fmax,
               row_number() OVER (PARTITION BY archivo_id, coalesce(folio, ''),
               coalesce(CASE WHEN trim(clerk_txt) = '' OR lower(trim(clerk_txt)) = 'nan' THEN NULL ELSE trim(clerk_txt) END, '') ORDER BY row_no) AS rn
           FROM sol_raw WHERE archivo_id % 10 = 5) WHERE rn = 1 GROUP BY archivo_id),
fate AS (
  SELECT g.*, CASE WHEN g.tipo = 'TIEMPOS_SOL' AND g.archivo_id % 10 = 7 THEN 'Sin renglones de encabezado'
                   WHEN g.tipo = 'TIEMPOS_SOL' AND g.archivo_id % 10 = 5
                     THEN CASE WHEN b.sin_fecha > 0 THEN 'null value in column "fecha" violates not-null constraint' END
                   WHEN g.tipo = 'TIEMPOS_CR' AND g.archivo_id % 10 = 4 THEN 'Faltan columnas clave en CR: tiempo_total_atencion'
                   WHEN g.tipo = 'TIEMPOS_CR' AND g.archivo_id % 10 = 6 THEN 'Sin renglones de datos'
                   ELSE i.mensaje_error END AS falla
  FROM gated g JOIN icat i ON i.id = g.archivo_id AND i.tipo = g.tipo LEFT JOIN bare b ON b.archivo_id = g.archivo_id AND g.tipo = 'TIEMPOS_SOL'),
roll AS (
  SELECT i.id, i.tipo, CASE WHEN b.archivo_id IS NULL THEN i.tipo_periodo WHEN b.primera <> b.ultima THEN 'SEMANAL' ELSE 'DIARIO' END AS periodo,
         coalesce(b.filas, i.registros_insertados) AS filas
  FROM icat i LEFT JOIN bare b ON b.archivo_id = i.id AND i.tipo = 'TIEMPOS_SOL')"""
    q["arrival_states"] = w(SOL, CR, LEDGER, UPLOADS, fate) + """
SELECT nombre_archivo, mac, tipo, CASE WHEN motivo IS NOT NULL THEN 'RECHAZADO' WHEN falla IS NOT NULL THEN 'ERROR' ELSE 'PROCESADO' END AS estatus,
       coalesce(motivo, falla, '') AS motivo, strftime(carga, '%Y-%m-%d %H:%M:%S') AS fecha_carga FROM fate"""
    q["ledger_states"] = w(SOL, CR, LEDGER, UPLOADS, fate) + """
SELECT f.nombre_archivo, f.mac, f.tipo, CASE WHEN falla IS NOT NULL THEN 'ERROR' ELSE 'PROCESADO' END AS estatus, coalesce(falla, '') AS mensaje_error,
       CAST(2 AS BIGINT) AS cambio, CASE WHEN falla IS NULL THEN i.periodo END AS tipo_periodo,
       CASE WHEN falla IS NULL THEN i.filas ELSE 0 END AS registros_insertados, strftime(carga, '%Y-%m-%d %H:%M:%S') AS fecha_carga
FROM fate f JOIN roll i ON i.id = f.archivo_id AND i.tipo = f.tipo WHERE f.motivo IS NULL"""
    q["reupload_states"] = w(SOL, CR, LEDGER) + """
SELECT nombre_archivo, estatus, coalesce(mensaje_error, '') AS motivo, coalesce(f.n, 0) AS filas
FROM icat LEFT JOIN (SELECT archivo_id, count(*) AS n FROM sol_facts GROUP BY archivo_id) f ON f.archivo_id = icat.id WHERE tipo = 'TIEMPOS_SOL'
UNION ALL
SELECT concat('copia_', nombre_archivo), 'RECHAZADO', 'contenido_repetido', 0 FROM icat WHERE tipo = 'TIEMPOS_SOL' AND id % 3 = 0"""
    q["stream_ingest"] = w(SOL) + f"""
SELECT nombre_archivo, mac, {sheet}, fecha, folio, funcionario, terminal, centesimas FROM sol_facts"""
    return q
