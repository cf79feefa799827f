"""Report cleaning and fact projection.

Input: report rows as the sheet reader yields them -- metadata columns
(``archivo_id``, ``nombre_archivo``, ``row_no``) plus one text column per
flattened header. Output: typed row-level DataFrames. All row-local, so
every function here is a narrow transformation (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.functions import columns as C

META_COLUMNS = ["archivo_id", "nombre_archivo", "row_no"]

# --- Fixed values: CR header -> column name, useful and required columns ---
CR_COLUMN_MAP = {
    "TERMINAL": "terminal",
    "SOLICITUD": "solicitud",
    "FECHA DE ENTREGA": "fecha_entrega",
    "FOLIO NEC": "folio_nec",
    "HORA INICIO ATENCIÓN": "hora_inicio_atencion",
    "CAPTURA TRAMITE_HORA INICIO": "captura_hora_inicio",
    "HORA FIN": "captura_hora_fin",
    "TIEMPO TOTAL DE CAPTURA": "captura_tiempo_total",
    "TIEMPO TOTAL DE ATENCIÓN": "tiempo_total_atencion",
}
CR_REQUIRED = ["terminal", "solicitud", "tiempo_total_atencion"]
# Header text that marks a repeated header row inside the data.
HEADER_TERMINAL = "TERMINAL"
HEADER_CLERK = "NOMBRE FUNCIONARIO"
# ---------------------------------------------------------------------------


def cell(df: DataFrame, name: str) -> Column:
    """A report column, or a typed NULL when the report lacks it."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def find_type_column(columns: list[str]) -> str | None:
    """the report's type column: the best-ranked candidate header (trimmed,
    any case); of headers that read alike the last one counts."""
    rank = {name: i for i, name in enumerate(C.TYPE_COLUMN_CANDIDATES)}
    found = [(rank[c.strip().upper()], -at, c) for at, c in enumerate(columns) if c.strip().upper() in rank]
    return min(found)[2] if found else None


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META_COLUMNS]


def clean_sol_report(df: DataFrame, has_terminal: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drop rows without terminal and repeated header rows (when the
    report has the column), then rows whose cells are all null.

    ``has_terminal`` tells it per row where reports of several files meet;
    ``extra`` columns are no cells and do not stay."""
    out = df
    if HEADER_TERMINAL in df.columns:
        t = F.col(HEADER_TERMINAL)
        usable = t.isNotNull() & ~C.is_heading(t, HEADER_TERMINAL)
        out = out.where(usable if has_terminal is None else ~has_terminal | usable)
    out = out.drop(*extra)
    data = _data_columns(out)
    return out.na.drop(how="all", subset=data) if data else out


def sol_rows(clean: DataFrame) -> DataFrame:
    """P8 row projection of cleaned SOL rows (one row per report row).

    Typed fact columns plus the raw terminal / clerk texts the relative
    metrics group on. Built in stages (strip -> parse -> derive) so that
    each parsed value is computed once and referenced by name after."""
    type_col = find_type_column(clean.columns)
    tipo_raw = cell(clean, type_col) if type_col else F.lit(None).cast("string")
    clerk_raw = cell(clean, "NOMBRE FUNCIONARIO")
    stripped = clean.select(
        "archivo_id", "nombre_archivo", "row_no",
        cell(clean, "TERMINAL").alias("terminal_txt"),
        C.strip_cell(cell(clean, "TERMINAL")).alias("_terminal"),
        C.strip_cell(cell(clean, "SOLICITUD")).alias("_folio"),
        C.strip_cell(tipo_raw).alias("_tipo"),
        C.strip_cell(clerk_raw).alias("_clerk"),
        C.strip_cell(cell(clean, "DOMICILIO VISIBLE")).alias("_dom"),
        C.strip_cell(cell(clean, "FECHA DE TRAMITE")).alias("_fecha"),
        C.strip_cell(cell(clean, "HORA INICIO ATENCIÓN")).alias("_hi"),
        C.strip_cell(cell(clean, "HORA FIN ATENCIÓN")).alias("_hf"),
        C.strip_cell(cell(clean, "TIEMPO TOTAL DE ATENCIÓN")).alias("_dur"))
    parsed = stripped.select(
        "*", C.office_of("nombre_archivo").alias("mac"), C.parse_date("_fecha").alias("fecha"),
        C.duration_us("_dur").alias("duracion_us"), C.duration_us("_hi").alias("_hi_us"),
        C.duration_us("_hf").alias("_hf_us"), C.normalized_stripped_type("_tipo").alias("_tipo_norm"))
    categoria = C.category_of_normalized("_tipo_norm") if type_col else F.lit(C.UNCLASSIFIED)
    derived = parsed.select(
        "archivo_id", "nombre_archivo", "mac", "row_no", "fecha",
        C.clean_stripped("_folio").alias("folio"),
        C.clean_stripped("_tipo").alias("tipo_tramite"),
        categoria.alias("categoria"),
        C.clean_stripped("_clerk").alias("funcionario"),
        C.clean_stripped("_terminal").alias("terminal"),
        C.clean_stripped("_dom").alias("domicilio_visible"),
        F.lit(None).cast("string").alias("estatus_tramite"),
        C.combine_date_time("fecha", "_hi", "_hi_us").alias("hora_inicio"),
        C.combine_date_time("fecha", "_hf", "_hf_us").alias("hora_fin"),
        "duracion_us", C.hundredths_of_us("duracion_us").alias("centesimas"),
        "terminal_txt", F.coalesce(F.col("_clerk"), F.lit("nan")).alias("funcionario_txt"))
    return derived.withColumn("dentro_norma", C.within_norm("centesimas"))


def clerk_rows(rows: DataFrame) -> DataFrame:
    """P10: rows with a usable clerk name (not blank, not the header text, not 'nan')."""
    t = F.col("funcionario_txt")
    return rows.where((F.length(t) > 0) & (F.upper(t) != HEADER_CLERK) & (F.lower(t) != "nan"))


def clean_cr_report(df: DataFrame) -> DataFrame:
    """Rename, prune, check required columns, filter, normalise, derive.

    The row filter (P6 + valid duration) is written on the raw stripped
    texts and applied before any derived column, so predicate pushdown has
    nothing expensive to copy into the scan-side filter."""
    stripped = df.toDF(*[c.strip() if c not in META_COLUMNS else c for c in df.columns])
    # The mapped columns that are there, under their names
    keep = [name for header, name in CR_COLUMN_MAP.items() if header in stripped.columns]
    renamed = stripped.withColumnsRenamed(CR_COLUMN_MAP)
    absent = sorted(set(CR_REQUIRED).difference(keep), key=CR_REQUIRED.index)          # P4
    if absent:
        raise ValueError("Faltan columnas clave en CR: " + ", ".join(absent))
    meta = [c for c in META_COLUMNS if c in renamed.columns]
    d = F.col("tiempo_total_atencion")
    rows = renamed.select(*meta, *keep).where(                         # P6 + valid duration
        C.not_blank("terminal") & C.not_blank("solicitud") & ~C.is_heading("terminal", HEADER_TERMINAL)
        & (d.rlike(C.PLAIN_DURATION) | C.duration_ok(C.strip(d))))
    norm = {"terminal": C.strip_cell("terminal"), "solicitud": C.strip_cell("solicitud"),
            "_dur": C.strip_cell("tiempo_total_atencion")}             # P5 (non-blank here)
    if "folio_nec" in keep:
        norm["folio_nec"] = C.strip_cell("folio_nec")
    if "fecha_entrega" in keep:
        norm["_fecha"] = C.strip_cell("fecha_entrega")
    out = rows.withColumns(norm)
    derived = {"duracion_us": C.duration_us("_dur")}
    if "folio_nec" in keep:
        derived["folio_nec"] = F.nullif(F.col("folio_nec"), F.lit(""))
    if "fecha_entrega" in keep:
        derived["fecha_entrega"] = C.parse_date("_fecha")
    if "nombre_archivo" in out.columns:
        derived["mac"] = C.office_of("nombre_archivo")
    out = out.withColumns(derived).drop("_dur", "_fecha")
    return out.withColumn("centesimas", C.hundredths_of_us("duracion_us"))    # P7


def cr_fact_projection(clean: DataFrame) -> DataFrame:
    """P9 projection of every cleaned CR row, with ``_p9`` telling whether the
    row is stored (date, request and terminal present). Used where the roll-up
    needs all cleaned rows and the store only the valid ones."""
    fecha = F.col("fecha_entrega") if "fecha_entrega" in clean.columns else F.lit(None).cast("date")
    staged = clean.select(
        "archivo_id", "nombre_archivo", "mac", "row_no", fecha.alias("fecha_entrega"), "solicitud",
        (C.clean_stripped("folio_nec") if "folio_nec" in clean.columns
         else F.lit(None).cast("string")).alias("folio_nec"), "terminal",
        C.strip_cell(cell(clean, "hora_inicio_atencion")).alias("_hi"),
        C.strip_cell(cell(clean, "captura_hora_fin")).alias("_hf"), "centesimas",
        (fecha.isNotNull() & C.has_value("solicitud") & C.has_value("terminal")).alias("_p9"))
    timed = staged.withColumns({"_hi_us": C.duration_us("_hi"), "_hf_us": C.duration_us("_hf")})
    return timed.select(
        "archivo_id", "nombre_archivo", "mac", "row_no", "fecha_entrega",
        F.when(C.has_value("solicitud"), F.col("solicitud")).alias("solicitud"), "folio_nec",
        F.when(C.has_value("terminal"), F.col("terminal")).alias("terminal"),
        C.combine_date_time("fecha_entrega", "_hi", "_hi_us").alias("hora_inicio"),
        C.combine_date_time("fecha_entrega", "_hf", "_hf_us").alias("hora_fin"),
        "centesimas", C.within_norm("centesimas").alias("dentro_norma"), "_p9")
