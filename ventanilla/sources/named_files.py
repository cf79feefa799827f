"""One named file per report, written by the executors and put in place on commit.

Two write-only Python data sources over the columns ``tipo, reporte`` and the
report's own: ``reporte_csv`` (CSV, UTF-8 with byte order mark) and
``reporte_hoja`` (workbook of one sheet; own columns ``row_no, cells``). A
task streams each report's rows into a file of its own try; the driver gets
only the names and renames them on commit, so a lost executor, a task run
twice or a failed job leaves no half report. A name that cannot be taken (held
by a folder, not permitted, or kept on purpose with ``ocupado = conservar``)
falls back to the time-stamped name. What was put in place is listed in
``_confirmados/<try>.json``.

Rows of a workbook come as Arrow batches and their XML is built for many cells at once.

A report's rows must stand in one task, next to each other: ``write_named``
sees to it. Reports found in two tasks, or whose names differ only in
characters that file names cannot hold, are refused and nothing is put in
place. A null name becomes ``sin_nombre``; nulls become empty cells; no rows
give no files.
"""

from __future__ import annotations

import codecs
import csv
import dataclasses
import datetime as dt
import io
import json
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from ventanilla.sources.shared_files import locate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("tipo", "reporte")
CONFIRMED, TRY = "_confirmados", "_intento-"
#: Option for a name that is taken: replace it, or keep it and write beside it.
TAKEN, REPLACE, KEEP = "ocupado", "reemplazar", "conservar"
NO_NAME = "sin_nombre"


def safe_name(name: str | None) -> str:
    """A name as one part of a path."""
    name = re.sub(r"[/\\\x00-\x1f]", "_", name or "")
    return NO_NAME if name.strip(". ") == "" else name


class CsvFile:
    """A CSV file being written: header, then rows; numbers as Python shows them."""

    suffix = ".csv"

    def __init__(self, out, columns: list[str]) -> None:
        self.out = out
        out.write(codecs.BOM_UTF8)
        self.text = io.TextIOWrapper(out, "utf-8", newline="", write_through=False)
        self.csv = csv.writer(self.text, lineterminator="\n")
        self.csv.writerow(columns)

    def add(self, values: tuple) -> None:
        self.csv.writerow(["" if v is None else v for v in values])

    def close(self) -> None:
        self.text.flush()
        self.text.detach()
        self.out.close()


# Fixed parts of a workbook of one sheet.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
WORKBOOK_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" '
                           'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           f'<Override PartName="/xl/workbook.xml" ContentType="{_KINDS}.sheet.main+xml"/>'
                           f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KINDS}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" '
                   'Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="Reporte" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/worksheet" '
                                  'Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Marks of XML and how a text holds them; characters that XML cannot hold are left out.
_XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;",
        **dict.fromkeys([*map(chr, range(9)), "\x0b", "\x0c", *map(chr, range(14, 32)), "\ufffe", "\uffff"], "")}
_XML_TABLE = str.maketrans(_XML)
_XML_MARKS = "".join(_XML)
#: Rows of a sheet whose XML is built and handed to the compressor at once.
_ROWS = 1000


class SheetFile:
    """A workbook being written: rows ``(row_no, cells)`` by rising number, cells as texts."""

    suffix = ".xlsx"

    def __init__(self, out, columns: list[str]) -> None:
        if list(columns) != ["row_no", "cells"]:
            raise ValueError("a sheet takes the columns row_no and cells")
        self.out = out
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        for name, xml in WORKBOOK_PARTS.items():
            self.zip.writestr(name, _HEAD + xml)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())

    def add(self, values: tuple[pa.Array, pa.ListArray]) -> None:
        numbers, cells = values
        for at in range(0, len(numbers), _ROWS):
            self.sheet.write(_rows_xml(numbers.slice(at, _ROWS), cells.slice(at, _ROWS)))

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        self.out.close()


def _rows_xml(numbers: pa.Array, cells: pa.ListArray) -> memoryview:
    """The rows as XML; empty cells are left out."""
    said = pc.fill_null(numbers.cast(pa.large_string()), "None")
    sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy()
    texts = cells.flatten().cast(pa.large_string())
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(texts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = np.flatnonzero(pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False))
    if len(held) < len(texts):
        texts, row, column = texts.take(pa.array(held)), row[held], column[held]
    texts = _escaped(texts)
    letters = pa.array([_letters(i) for i in range(column.max(initial=-1) + 1)], pa.large_string())
    xml = _joined('<c r="', letters.take(pa.array(column)), said.take(pa.array(row)),
                  '" t="inlineStr"><is><t xml:space="preserve">', texts, "</t></is></c>")
    ends = np.cumsum(np.bincount(row, minlength=len(sizes)))
    of_row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), xml)
    rows = _joined('<row r="', said, '">', pc.binary_join(of_row, _large("")), "</row>")
    whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
    return memoryview(pc.binary_join(whole, _large(""))[0].as_buffer())


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _joined(*parts: str | pa.Array) -> pa.Array:
    """Texts joined element by element."""
    return pc.binary_join_element_wise(*[_large(p) if isinstance(p, str) else p for p in parts], _large(""))


def _escaped(texts: pa.Array) -> pa.Array:
    """Texts as XML holds them; only those with marks are translated."""
    if not len(texts):
        return texts
    marked = pc.match_substring_regex(texts, f"[{re.escape(_XML_MARKS)}]")
    at = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    order = np.arange(len(texts))
    order[at] = len(texts) + np.arange(len(at))
    changed = pa.array([t.translate(_XML_TABLE) for t in texts.take(pa.array(at)).to_pylist()], texts.type)
    return pa.concat_arrays([texts, changed]).take(pa.array(order))


def _letters(column: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    out = ""
    while column >= 0:
        out = chr(ord("A") + column % 26) + out
        column = column // 26 - 1
    return out


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """Files of one task: written path, kind, report, rows."""

    files: list


class NamedFilesWriter(DataSourceWriter):
    """Writes every report to a file of this try; renames on commit, removes the try on abort."""

    def __init__(self, kind: type, schema: T.StructType, folder: str, taken: str) -> None:
        names = schema.fieldNames()
        if any(k not in names for k in KEYS) or taken not in (REPLACE, KEEP):
            raise ValueError(f"needs the columns {KEYS} and {TAKEN} = {REPLACE} or {KEEP}")
        self.kind, self.folder, self.taken, self.id = kind, folder.rstrip("/"), taken, uuid.uuid4().hex[:12]
        self.keys = [names.index(k) for k in KEYS]
        self.own = [i for i, n in enumerate(names) if n not in KEYS]
        self.columns = [names[i] for i in self.own]

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, folder = locate(self.folder)
        return system, folder, f"{folder}/{TRY}{self.id}"

    def write(self, iterator: Iterator[Row]) -> Written:
        return self._written((tuple(row[i] for i in self.keys), tuple(row[i] for i in self.own), 1) for row in iterator)

    def _written(self, parts: Iterator[tuple[tuple, tuple, int]]) -> Written:
        """Writes parts of reports: key, what the file takes, rows."""
        system, _, tried = self._place()
        mine = f"{tried}/{uuid.uuid4().hex}"  # a task run twice writes twice; one of them is confirmed
        files, now, held = [], (), None
        for key, values, rows in parts:
            if key != now:
                if held:
                    held.close()
                system.create_dir(mine, recursive=True)
                path = f"{mine}/{len(files)}"
                files.append([path, *map(safe_name, key), 0])
                held, now = self.kind(system.open_output_stream(path), self.columns), key
            held.add(values)
            files[-1][3] += rows
        if held:
            held.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, folder, tried = self._place()
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1:3])
        for a, b in zip(files, files[1:], strict=False):
            if a[1:3] == b[1:3]:
                raise ValueError(f"report {b[1]}/{b[2]} was written twice: its rows stand apart, or two names give one file name")
        stamp = dt.datetime.now().strftime("%Y%m%d_%H%M%S")
        lines = []
        for path, kind, report, rows in files:
            system.create_dir(f"{folder}/{kind}", recursive=True)
            name = self._take(system, path, f"{folder}/{kind}", report, stamp)
            lines.append(json.dumps({"tipo": kind, "reporte": report, "archivo": name, "renglones": rows}, ensure_ascii=False))
        system.create_dir(f"{folder}/{CONFIRMED}", recursive=True)
        with system.open_output_stream(f"{folder}/{CONFIRMED}/{self.id}.json") as out:
            out.write("".join(line + "\n" for line in lines).encode())
        self.abort(messages)

    def _take(self, system: fs.FileSystem, path: str, folder: str, report: str, stamp: str) -> str:
        """Renames a written file to the report's name, or to the next free one with the time behind it."""
        first = report + self.kind.suffix
        there = system.get_file_info(f"{folder}/{first}").type
        if there == fs.FileType.NotFound or there == fs.FileType.File and self.taken == REPLACE:
            try:
                system.move(path, f"{folder}/{first}")
                return first
            except PermissionError:
                pass
        n, name = 1, f"{report}_{stamp}{self.kind.suffix}"
        while system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
            n += 1
            name = f"{report}_{stamp}_{n}{self.kind.suffix}"
        system.move(path, f"{folder}/{name}")
        return name

    def abort(self, messages: list) -> None:
        """Removes this try's folder, nothing else."""
        system, _, tried = self._place()
        if system.get_file_info(tried).type == fs.FileType.Directory:
            system.delete_dir(tried)


class NamedSheetsWriter(NamedFilesWriter, DataSourceArrowWriter):
    """The same from Arrow batches, which hold rows of one report after another."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._written(part for batch in iterator for part in self._parts(batch))

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple, int]]:
        keys, own = [batch.column(i) for i in self.keys], [batch.column(i) for i in self.own]
        changes = np.zeros(max(len(batch) - 1, 0), bool)
        for k in keys:
            changes |= np.diff(k.dictionary_encode("encode").indices.to_numpy()) != 0
        bounds = [0, *(np.flatnonzero(changes) + 1), len(batch)] if len(batch) else []
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield tuple(k[a].as_py() for k in keys), tuple(c.slice(a, b - a) for c in own), int(b - a)


class ReportCsv(DataSource):
    """``reporte_csv``: one CSV file per report."""

    kind = CsvFile
    named_writer = NamedFilesWriter

    @classmethod
    def name(cls) -> str:
        return "reporte_csv"

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedFilesWriter:
        return self.named_writer(self.kind, schema, self.options["path"], self.options.get(TAKEN, REPLACE))


class ReportSheet(ReportCsv):
    """``reporte_hoja``: one workbook per report."""

    kind = SheetFile
    named_writer = NamedSheetsWriter

    @classmethod
    def name(cls) -> str:
        return "reporte_hoja"


def write_named(rows: DataFrame, folder: str, order: list[str | Column], source: type[ReportCsv] = ReportCsv, taken: str = REPLACE) -> None:
    """Writes ``rows`` (``tipo, reporte`` and the report's columns) as one file per report, its rows in ``order``."""
    rows.sparkSession.dataSource.register(source)
    (rows.repartition(*KEYS).sortWithinPartitions(*KEYS, *order)
         .write.format(source.name()).option(TAKEN, taken).mode("append").save(folder))
