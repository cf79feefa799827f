"""Report files: listing, reading, header flattening (S1-S7, S4, U1, S10 ids).

Re-aim of the spreadsheet reader: a report is a tab-delimited export of
its sheet, one line per sheet row, each line starting with the sheet row
number (1-based). Reading is then a splittable ``spark.read.text`` -- a
huge report is spread over many tasks, never loaded whole into one -- and
the header rows are found by row number. Cells must not contain tabs or
line breaks.

Layout parameters (fixed by the two report kinds):
SOL: header rows 21-22, data from row 23; CR: header rows 16-17, data from 18.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventanilla.functions import columns as C
from ventanilla.session import staged

SOL_LAYOUT = {"header_row": 21, "strip_header": False, "drop_empty_rows": False}
CR_LAYOUT = {"header_row": 16, "strip_header": True, "drop_empty_rows": True}
#: Part files of a report that may have several.
SLICES = 8
UNNAMED = "col_sin_nombre"
REPORT_SUFFIXES = ("xls", "xlsx")


def list_reports(spark: SparkSession, folder: str, suffixes=REPORT_SUFFIXES) -> DataFrame:
    """S1 + F1 + F2: report files of a folder with office and type from the name.
    Only file metadata is read (the binaryFile ``content`` column is pruned)."""
    glob = "*.{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*.{suffixes[0]}"
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder)
             .select("path", "modificationTime", "length"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("archivo"), C.office_of(name).alias("mac"),
                        C.report_type_of(name).alias("tipo"), "path", "modificationTime", "length")


def file_id(path_col, mtime_col):
    """A stable file id: a retried load of the same file gets the same id."""
    return F.xxhash64(path_col, mtime_col)


def cells_of_lines(lines: DataFrame, by_directory: bool = False) -> DataFrame:
    """Sheet rows from text lines with file metadata: (archivo_id, nombre_archivo,
    path, modificationTime, row_no, cells). With ``by_directory`` a report is a
    'reporte=<name>' folder that may hold several part files (one id per report)."""
    meta = F.col("_metadata")
    path = meta.getField("file_path")
    folder_name = F.regexp_extract(path, r"reporte=([^/]+)/", 1)
    name = F.when(folder_name != "", folder_name).otherwise(meta.getField("file_name"))
    fid = F.xxhash64(name) if by_directory else file_id(path, meta.getField("file_modification_time"))
    parts = F.split("value", "\t")
    return lines.select(
        fid.alias("archivo_id"), name.alias("nombre_archivo"), path.alias("path"),
        meta.getField("file_modification_time").alias("modificationTime"),
        F.element_at(parts, 1).try_cast("bigint").alias("row_no"),
        F.slice(parts, 2, F.size(parts) - 1).alias("cells"))


def read_cells(spark: SparkSession, folder: str, by_directory: bool = False) -> DataFrame:
    """Batch read of every export under ``folder`` (splittable text read; no Python)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", "_metadata")
    return cells_of_lines(lines, by_directory)


def stored_cells(cells: DataFrame) -> DataFrame:
    """The cells written once, apart by kind (``tipo``), as headers, columns and rows of a file are read one after another."""
    return staged(cells.withColumn("tipo", C.report_type_of("nombre_archivo")), "celdas", ["tipo"])


def export_lines(rows: DataFrame, headers: list[str], header_row: int, title: str) -> DataFrame:
    """Lines of tab-delimited sheet exports for report rows (one report per
    ``nombre_archivo``): a title row, the two header rows (a name 'A_B' is
    split over both rows), then data rows numbered after the header, in
    ``row_no`` order. Output: (reporte, row_no, value)."""
    fixed = [(n, "\t".join([str(n), *cells])) for n, cells in _head_rows(headers, header_row, title)]
    lines = F.array(*[F.struct(F.lit(n).cast("bigint").alias("row_no"), F.lit(line).alias("value")) for n, line in fixed])
    top = rows.select(F.col("nombre_archivo").alias("reporte")).distinct().select("reporte", F.inline(lines))
    sheet_row = (F.col("row_no") + header_row + 2).cast("bigint")
    data = rows.select(F.col("nombre_archivo").alias("reporte"), sheet_row.alias("row_no"),
                       F.concat_ws("\t", sheet_row.cast("string"),
                                   *[F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in headers]).alias("value"))
    return top.unionByName(data)


def _head_rows(headers: list[str], header_row: int, title: str) -> list[tuple[int, list[str]]]:
    """Number and cells of the title row and the two header rows of a report."""
    h1 = [h.split("_", 1)[0] if "_" in h else h for h in headers]
    h2 = [h.split("_", 1)[1] if "_" in h else "" for h in headers]
    return [(1, [title] + [""] * (len(headers) - 1)), (header_row, h1), (header_row + 1, h2)]


def sheet_rows(rows: DataFrame, headers: list[str], header_row: int, title: str) -> DataFrame:
    """The rows of ``export_lines`` with their cells: ``reporte, row_no, cells``."""
    fixed = [F.struct(F.lit(n).cast("bigint").alias("row_no"), F.array(*[F.lit(c) for c in cells]).alias("cells"))
             for n, cells in _head_rows(headers, header_row, title)]
    top = rows.select(F.col("nombre_archivo").alias("reporte")).distinct().select("reporte", F.inline(F.array(*fixed)))
    return top.unionByName(rows.select(F.col("nombre_archivo").alias("reporte"), (F.col("row_no") + header_row + 2).cast("bigint").alias("row_no"),
                                       F.array(*[F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in headers]).alias("cells")))


def write_exports(lines: DataFrame, out_dir: str, one_file_per_report: bool = False) -> None:
    """Write export lines as 'reporte=<name>/part-*.txt'. With ``one_file_per_report``
    each report becomes a single file (the arrival unit of a landing folder)."""
    # a task writes slices of few reports, so the number of files does not grow with tasks times reports
    w = lines.repartition("reporte") if one_file_per_report else lines.repartition("reporte", F.pmod(F.xxhash64("row_no"), F.lit(SLICES)))
    (w.sortWithinPartitions("reporte", "row_no").select("reporte", "value")
      .write.mode("overwrite").partitionBy("reporte").text(out_dir))


def _empty_to_null_array(arr):
    """An empty cell is missing; a cell holding only blanks is text (as in a sheet)."""
    return F.transform(arr, lambda x: F.when(x != "", x))


def flatten_headers(cells: DataFrame, header_row: int, strip_parts: bool) -> DataFrame:
    """Per file, the column names from the two header rows: both -> 'a_b',
    one -> that one, none -> 'col_sin_nombre'; a repeated name gets '_<position>'."""
    def row(n):
        return F.collect_list(F.when(F.col("row_no") == n, _empty_to_null_array("cells")))
    # both rows in one reading of the cells
    both = (cells.where(F.col("row_no").isin(header_row, header_row + 1)).groupBy("archivo_id")
            .agg(row(header_row).alias("_1"), row(header_row + 1).alias("_2")))
    h = (both.select("archivo_id", "_2", F.explode_outer("_1").alias("h1")).select("archivo_id", "h1", F.explode_outer("_2").alias("h2")))
    n = F.greatest(F.coalesce(F.size("h1"), F.lit(0)), F.coalesce(F.size("h2"), F.lit(0)))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def part(arr, i):
        v = F.try_element_at(F.coalesce(arr, F.array().cast("array<string>")), i)
        return C.strip(v) if strip_parts else v

    names = F.transform(idx, lambda i: F.when(part("h1", i).isNotNull() & part("h2", i).isNotNull(),
                                              F.concat_ws("_", part("h1", i), part("h2", i)))
                        .otherwise(F.coalesce(part("h1", i), part("h2", i), F.lit(UNNAMED))))
    named = h.select("archivo_id", names.alias("_n"))
    # in order: a name already given gets its position, again until it is new
    def give(given, item):
        name, at = item["x"], (item["i"] + 1).cast("string")
        second = F.concat(name, F.lit("_"), at)
        third = F.concat(second, F.lit("_"), at)
        return F.concat(given, F.array(F.when(~F.array_contains(given, name), name)
                                        .when(~F.array_contains(given, second), second)
                                        .when(~F.array_contains(given, third), third)
                                        .otherwise(F.concat(third, F.lit("_"), F.size(given).cast("string")))))
    items = F.transform("_n", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    unique = F.aggregate(items, F.array().cast("array<string>"), give)
    return named.select("archivo_id", unique.alias("columnas"))


def report_rows(cells: DataFrame, columns: list[str], header_row: int, strip_header: bool,
                drop_empty_rows: bool = False, any_case: list[str] = (), apart: bool = False) -> DataFrame:
    """Data rows (below the two header rows) as named text columns.
    Each row's cells are keyed by its file's header (a broadcastable per-file
    table: one row per file) and the wanted ``columns`` are projected. Headers
    in ``any_case`` match trimmed and in any case; of several the last counts.
    ``apart`` writes the table of headers first, so that its size tells how it is
    joined: a small one to the rows where they are. It pays for many rows."""
    hdr = flatten_headers(cells, header_row, strip_header)
    data = cells.where(F.col("row_no") > header_row + 1)
    if drop_empty_rows:
        data = data.where(F.ltrim(F.array_join("cells", ""), F.lit(C.PY_BLANKS)) != "")
    alike = F.transform("columnas", lambda x: F.upper(C.strip(x)))
    # where a column stands is found once per file: in a row of n cells, the last place up to n
    heads = {c: (alike if c in any_case else F.col("columnas")) for c in columns}
    places = hdr.select("archivo_id", *[_last_places(names, c).alias(f"_en{i}") for i, (c, names) in enumerate(heads.items())])
    j = data.join(staged(places, "encabezados") if apart else places, "archivo_id", "inner")

    def value(i):
        n = F.least(F.size(f"_en{i}"), F.size("cells"))
        return F.nullif(F.get("cells", F.get(f"_en{i}", n - 1)), F.lit(""))
    return j.select("archivo_id", "nombre_archivo", "row_no", *[value(i).alias(c) for i, c in enumerate(heads)])


def _last_places(names, wanted: str):
    """For every prefix of ``names`` the place (from 0) of its last ``wanted``, or null."""
    places = F.transform(names, lambda x, i: F.when(x == wanted, i))
    return F.transform(places, lambda _, i: F.array_max(F.slice(places, 1, i + 1)))


def probe(cells: DataFrame, first: int = 21, last: int = 60) -> DataFrame:
    """Shape of every file (rows, widest row) and its rows ``first``..``last``."""
    shape = cells.groupBy("archivo_id", "nombre_archivo").agg(
        F.count(F.lit(1)).alias("filas"), F.max(F.size("cells")).alias("columnas"))
    window = cells.where(F.col("row_no").between(first, last)).select("archivo_id", "row_no", "cells")
    return shape, window


def latest_file(files: DataFrame) -> DataFrame:
    """The most recently modified file (one row; ties -> larger path)."""
    return files.agg(F.max_by(F.struct("path", "modificationTime"),
                              F.struct("modificationTime", "path")).alias("f")).select("f.*").where("path is not null")


def union_listings(listings: list[DataFrame]) -> DataFrame:
    """All files matched by several globs."""
    out = listings[0]
    for d in listings[1:]:
        out = out.unionByName(d)
    return out.dropDuplicates(["path"])


def read_csv_report(spark: SparkSession, path: str) -> DataFrame:
    """S7 + D5: CSV report with header (a UTF-8 BOM is dropped); repeated header
    names keep their first occurrence; names are stripped and lower-cased. A path
    that does not exist gives an empty report without columns."""
    from ventanilla.operators.compare import normalize_header
    try:
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([]))
    return normalize_header(df)
