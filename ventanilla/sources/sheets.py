"""Spreadsheet reports (S2, S3, S5): typed cells of the first sheet of zipped-XML workbooks.

Files come from Spark's ``binaryFile`` listing, in batch or as a stream, with
the content column pruned. A sheet is one deflate stream and cannot be read
from its middle, but inflating costs little beside parsing: one task inflates
the sheet once and cuts it between rows into blocks, which are compressed and
dealt over all tasks; each task reads its blocks one by one, a plainly written
one at once (``plain_rows``) and any other a few rows at a time. So the work grows
with the sheet. The cells have the layout of ``reports.read_cells``, so headers,
cleaners and error records are shared.

Cell texts: text as it is; whole numbers without a fraction; dates as
``yyyy-MM-dd``, with ``HH:mm:ss`` behind unless midnight; times of day as
``HH:mm:ss``; errors and empty cells as ''. ``tipos`` tells them apart
(texto, numero, fecha, hora, logico; null for an empty cell). A file that is
no workbook, or breaks off, gives one row without number that says so in
``motivo`` (behind the rows before the break). Spark's listing leaves files of
no bytes out, so they and folders without files give no rows.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import sys
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.session import staged
from ventanilla.sources import plain_rows
from ventanilla.sources.shared_files import locate

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "path string, modificationTime timestamp, length bigint, content binary"
BLOCKS = "path string, modificationTime timestamp, inicio bigint, numero bigint, cabeza binary, bloque binary, largo bigint, motivo string"
CELLS = "path string, modificationTime timestamp, row_no bigint, cells array<string>, tipos array<string>, motivo string"
#: Inflated bytes of a block; rows of an Arrow batch; inflated bytes read at once.
BLOCK, ROWS, CHUNK = 8 << 20, 2000, 1 << 20
#: How blocks are compressed on their way to the tasks.
CODEC = "zstd"

# Fixed values of the workbook format: built-in number formats that show dates and times of day.
DATE_FORMATS = {14, 15, 16, 17, 22}
TIME_FORMATS = {18, 19, 20, 21, 45, 46, 47}

_ROW = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?row(?=[\s/>])[^>]*>")
_NUMBER = re.compile(rb"\sr\s*=\s*[\"'](\d+)[\"']")
_CLOSE = re.compile(rb"</(?:[A-Za-z_][\w.-]*:)?sheetData\s*>")
_DIGITS = "0123456789"
#: Bytes at the end of a block that are looked at first for its last row number.
TAIL = 1 << 14


def sheet_files(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """``path, modificationTime, length`` of the workbooks under ``folder`` (metadata only)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length")


def sheet_file_stream(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """The same, as a stream of files as they arrive."""
    files = (spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder))
    return files.select("path", "modificationTime", "length")


def read_sheets(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cells of every file of a listing: ``archivo_id, nombre_archivo, path, modificationTime, row_no, cells, tipos, motivo``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, loaded in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = 0
                try:
                    for start, number, head, xml in sheet_blocks(path, block):
                        packed = pa.compress(xml, codec=CODEC, asbytes=True)
                        yield _batch(BLOCK_FIELDS, path, loaded, [(start, number, head, packed, len(xml), None)])
                except WORKBOOK_ERRORS:
                    yield _batch(BLOCK_FIELDS, path, loaded, [(start, 0, b"", b"", 0, UNREADABLE)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reader = None, None
        for b in batches:
            for i, (path, loaded) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                number, head, packed, size, why = (b.column(k)[i].as_py() for k in range(3, 8))
                part = []
                if why is None:
                    try:
                        if known != path:
                            known, reader = path, cell_reader(path)
                        xml = pa.decompress(packed, decompressed_size=size, codec=CODEC, asbytes=True)
                        if (plain := _plain_block(xml, head, number, reader)) is not None:
                            yield _arrow_batch(CELL_FIELDS, path, loaded, [*plain, pa.nulls(len(plain[0]), pa.string())])
                            continue
                        for n, cells, kinds in _rows_of(io.BytesIO(head + xml), 0, sys.maxsize, reader, number):
                            part.append((n, cells, kinds, None))
                            if len(part) == ROWS:
                                yield _batch(CELL_FIELDS, path, loaded, part)
                                part = []
                    except WORKBOOK_ERRORS:
                        why = UNREADABLE
                if why is not None:
                    part.append((None, [], [], why))
                if part:
                    yield _batch(CELL_FIELDS, path, loaded, part)

    found = files.select("path", "modificationTime").mapInArrow(cut, BLOCKS)
    # blocks of one large sheet go to different tasks
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = found.repartition(tasks, "path", "inicio").mapInArrow(read, CELLS)
    name = F.substring_index("path", "/", -1)
    return cells.select(F.xxhash64("path", "modificationTime").alias("archivo_id"), name.alias("nombre_archivo"), "path",
                        "modificationTime", "row_no", "cells", "tipos", "motivo")


def whole_files(cells: DataFrame) -> DataFrame:
    """The cells of the files that could be read to their end. Reads ``cells`` twice: store them first."""
    broken = staged(cells.where("motivo is not null").select("archivo_id").distinct(), "ilegibles")
    return cells.join(broken, "archivo_id", "left_anti")


UNREADABLE = "Libro ilegible"
WORKBOOK_ERRORS = (StopIteration, zipfile.BadZipFile, zlib.error, EOFError, KeyError, ValueError, IndexError, NotImplementedError, RuntimeError, ET.ParseError,
                   expat.ExpatError)
BLOCK_FIELDS = [("inicio", pa.int64()), ("numero", pa.int64()), ("cabeza", pa.binary()), ("bloque", pa.binary()), ("largo", pa.int64()),
                ("motivo", pa.string())]
CELL_FIELDS = [("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("tipos", pa.list_(pa.string())), ("motivo", pa.string())]


def _batch(fields: list, path: str, loaded: pa.Scalar, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one file as a batch, behind its path and time."""
    return _arrow_batch(fields, path, loaded, [pa.array(values, kind) for (_, kind), values in zip(fields, zip(*rows, strict=True), strict=True)])


def _arrow_batch(fields: list, path: str, loaded: pa.Scalar, columns: list[pa.Array]) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(loaded, n), *columns]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "modificationTime", *[n for n, _ in fields]])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class Workbook:
    """Directory, date system, styles and shared texts of one open workbook."""

    def __init__(self, path: str) -> None:
        system, inside = locate(path)
        self.zip = zipfile.ZipFile(system.open_input_file(inside))
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        first = next(e for e in book.iter() if _local(e.tag) == "sheet")
        link = next(v for k, v in first.attrib.items() if k.endswith("}id"))
        links = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = next(e.attrib["Target"] for e in links if e.attrib["Id"] == link)
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        since_1904 = any(_local(e.tag) == "workbookPr" and e.attrib.get("date1904") in ("1", "true") for e in book.iter())
        self.epoch = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)

    def kinds_of_styles(self) -> list[str]:
        """Per cell style: numero, fecha or hora."""
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        root = ET.fromstring(self.zip.read("xl/styles.xml"))
        codes = {int(e.attrib["numFmtId"]): e.attrib.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
        styles = next((e for e in root if _local(e.tag) == "cellXfs"), ())
        return [_kind_of_format(int(e.attrib.get("numFmtId", 0)), codes) for e in styles]

    def shared_texts(self) -> list[str]:
        """The texts that cells name by number (phonetic readings left out)."""
        out = []
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return out
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if _local(e.tag) == "si":
                    out.append(_plain(e))
                    e.clear()
        return out


def _kind_of_format(number: int, codes: dict[int, str]) -> str:
    if number in codes:
        code = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*[^\]hmsHMS][^\]]*\]', "", codes[number]).lower()
        return "fecha" if re.search("[yd]", code) else "hora" if re.search("[hs]", code) else "numero"
    return "fecha" if number in DATE_FORMATS else "hora" if number in TIME_FORMATS else "numero"


def _plain(e: ET.Element) -> str:
    """The text of a text element: its own, or that of its formatted runs."""
    parts = []
    for child in e:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(parts)


def sheet_size(path: str) -> int:
    """Inflated bytes of the first sheet, from the directory."""
    book = Workbook(path)
    with book.zip:
        return book.zip.getinfo(book.sheet).file_size


def sheet_rows(path: str, start: int, end: int) -> Iterator[tuple[int, list[str], list[str | None]]]:
    """``row number, cell texts, kinds`` of the rows whose tag begins at inflated bytes ``start`` to ``end``.

    A row without a number follows the one before, so the tags of the rows
    before the block are looked at, and no more of them.
    """
    book = Workbook(path)
    with book.zip, book.zip.open(book.sheet) as f:
        yield from _rows_of(f, start, end, cell_reader(path))


def cell_reader(path: str) -> Callable:
    """Text and kind of a cell by its type, style and value, from the workbook's styles, shared texts and date system."""
    book = Workbook(path)
    with book.zip:
        kinds, texts = book.kinds_of_styles(), book.shared_texts()
    return lambda said, style, raw: _cell(said, style, raw, kinds, texts, book.epoch)


def sheet_blocks(path: str, block: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """``start, number, head, xml``: the first sheet, inflated once and cut before row tags into blocks of at least
    ``block`` bytes; the number of the row before a block, and the root's opening tag."""
    book = Workbook(path)
    with book.zip, book.zip.open(book.sheet) as f:
        head, buffer, at, number = None, b"", 0, 0
        while True:
            chunk = f.read(CHUNK)
            buffer += chunk
            if head is None:
                root = re.search(rb"<(?![?!])[^>]*>", buffer)
                if root is None:
                    if not chunk:
                        return
                    continue
                head, buffer, at = re.sub(rb"/>$", b">", root[0]), buffer[root.end():], root.end()
            while len(buffer) > block and (m := _ROW.search(buffer, block)):
                yield at, number, head, buffer[:m.start()]
                number = _last_number(buffer, m.start(), number)
                buffer, at = buffer[m.start():], at + m.start()
            if not chunk:
                if buffer:
                    yield at, number, head, buffer
                return


def _last_number(buffer: bytes, end: int, number: int) -> int:
    """The number of the last row that begins before ``end``; rows without one follow the row before."""
    back = TAIL
    while True:
        # the last row that says its number is mostly near the end: look further back only where it is not
        start, found, after = max(end - back, 0), None, 0
        for m in _ROW.finditer(buffer, start, end):
            said = _NUMBER.search(m[0])
            found, after = (int(said[1]), 0) if said else (found, after + 1)
        if found is not None or start == 0:
            return (number if found is None else found) + after
        back *= 8


def _plain_block(xml: bytes, head: bytes, number: int, cell: Callable) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """What ``_rows_of`` gives of a block, as columns, or None if the block is not plainly written."""
    first = _ROW.search(xml)
    if first is None:
        return None
    close = _CLOSE.search(xml, first.start()) if b"sheetData" in xml else None
    try:
        return plain_rows.block_rows(xml[first.start():close.start() if close else len(xml)], head, number, cell)
    except WORKBOOK_ERRORS:
        # a cell that cannot be read: the parser gives the rows before it
        return None


def _rows_of(f, start: int, end: int, cell: Callable, number: int = 0) -> Iterator[tuple[int, list[str], list[str | None]]]:
    """The rows of a sheet that begin from ``start`` to ``end``; ``number`` is that of the row before."""
    parser, rows = None, []
    head, buffer, at, inside = None, b"", 0, False
    while True:
        chunk = f.read(CHUNK)
        buffer += chunk
        if head is None:
            # the root's opening tag, with its namespaces, stands around the block
            root = re.search(rb"<(?![?!])[^>]*>", buffer)
            if root is None:
                if not chunk:
                    return
                continue
            head = re.sub(rb"/>$", b">", root[0])
        if not inside:
            done = 0
            for m in _ROW.finditer(buffer):
                if at + m.start() >= start:
                    if at + m.start() >= end:
                        return
                    inside = True
                    buffer, at = buffer[m.start():], at + m.start()
                    parser = _row_parser(cell, rows, number)
                    parser.Parse(head, False)
                    break
                said = _NUMBER.search(m[0])
                number, done = int(said[1]) if said else number + 1, m.end()
            if not inside:
                # an opening tag may be cut by the chunk: keep from the last "<" on
                keep = max(done, buffer.rfind(b"<")) if chunk else len(buffer)
                buffer, at = buffer[keep:] if keep >= 0 else b"", at + max(keep, 0)
                if not chunk:
                    return
                continue
        stop = _end_of_block(buffer, at, end)
        last = stop is not None or not chunk
        if last:
            feed, buffer = buffer[:stop], b""
        else:
            keep = max(buffer.rfind(b"<"), 0)
            feed, buffer, at = buffer[:keep], buffer[keep:], at + keep
        try:
            parser.Parse(feed, False)
        finally:
            # also the rows before a break
            yield from rows
            rows.clear()
        if last:
            return


def _end_of_block(buffer: bytes, at: int, end: int) -> int | None:
    """Where in the buffer the block stops: the first row tag from ``end`` on, or the end of the sheet's data."""
    close = _CLOSE.search(buffer)
    row = _ROW.search(buffer, max(end - at, 0)) if at + len(buffer) > end else None
    stops = [m.start() for m in (close, row) if m]
    return min(stops) if stops else None


# Where a parser of rows stands: outside rows, in a row, a cell, its value, its inline text, a text or a run of that, anywhere else.
_OUT, _IN_ROW, _IN_CELL, _IN_VALUE, _IN_INLINE, _IN_TEXT, _IN_RUN, _ELSEWHERE = range(8)


def _row_parser(cell: Callable, rows: list, number: int) -> expat.XMLParserType:
    """A parser that puts every row it has read to its end into ``rows``: number, cell texts, kinds.

    ``number`` is that of the row before. Of several values of a cell the first one counts, and of a
    text what stands before an element inside it."""
    parser = expat.ParserCreate(namespace_separator="}")
    parser.ordered_attributes = parser.buffer_text = True
    if hasattr(parser, "SetReparseDeferralEnabled"):
        parser.SetReparseDeferralEnabled(False)
    tags, places = {}, {}
    at, above, outer, parts = _OUT, [], [], []
    said_number, cells = None, []
    reference, said, style, held = None, "n", 0, False

    def start(name: str, attributes: list) -> None:
        nonlocal at, said_number, cells, reference, said, style, held
        tag = tags.get(name)
        if tag is None:
            tag = tags[name] = _local(name)
        above.append(_ELSEWHERE if at == _IN_VALUE or at == _IN_TEXT else at)
        if at == _IN_CELL:
            if held or tag != ("is" if said == "inlineStr" else "v"):
                at = _ELSEWHERE
            else:
                at, held = (_IN_VALUE if tag == "v" else _IN_INLINE), True
        elif at == _IN_INLINE:
            at = _IN_TEXT if tag == "t" else _IN_RUN if tag == "r" else _ELSEWHERE
        elif at == _IN_ROW and tag != "row":
            if tag != "c":
                at = _ELSEWHERE
                return
            at, reference, said, style, held = _IN_CELL, None, "n", 0, False
            parts.clear()
            for i in range(0, len(attributes), 2):
                key = attributes[i]
                if key == "r":
                    reference = attributes[i + 1]
                elif key == "t":
                    said = attributes[i + 1]
                elif key == "s":
                    style = attributes[i + 1]
        elif at == _IN_RUN:
            at = _IN_TEXT if tag == "t" else _ELSEWHERE
        elif at == _OUT or at == _IN_ROW:
            if tag == "row":
                # a row that is never closed has the next ones inside it
                outer.append((said_number, cells))
                at, cells = _IN_ROW, []
                said_number = dict(zip(attributes[::2], attributes[1::2], strict=True)).get("r")
        else:
            at = _ELSEWHERE

    def characters(text: str) -> None:
        if at == _IN_TEXT or at == _IN_VALUE:
            parts.append(text)

    def end(_: str) -> None:
        nonlocal at, number, said_number, cells
        if at == _IN_CELL:
            cells.append((reference, said, style, "".join(parts)))
        elif at == _IN_ROW:
            number = number + 1 if said_number is None else int(said_number)
            rows.append((number, *_cells_of(cells, cell, places)))
            said_number, cells = outer.pop()
        at = above.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    return parser


def _cells_of(cells: list[tuple], cell: Callable, places: dict[str, int]) -> tuple[list[str], list[str | None]]:
    """Texts and kinds of a row's cells ``(reference, type, style, value)``, with empty ones for those left out."""
    texts, kinds = [], []
    for reference, said, style, raw in cells:
        if reference is not None:
            letters = reference.rstrip(_DIGITS)
            place = places.get(letters)
            if place is None:
                place = places[letters] = _column(letters)
            while len(texts) < place:
                texts.append("")
                kinds.append(None)
        text, kind = cell(said, style, raw)
        texts.append(text)
        kinds.append(kind)
    return texts, kinds


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    letters = re.match("[A-Za-z]+", reference)
    if letters is None:
        raise ValueError(f"no column in {reference!r}")
    n = 0
    for c in letters[0].upper():
        n = n * 26 + ord(c) - ord("A") + 1
    return n - 1


def _cell(said: str, style: str | int, raw: str, kinds: list[str], texts: list[str], epoch: dt.datetime) -> tuple[str, str | None]:
    if said == "inlineStr":
        return raw, "texto" if raw else None
    if not raw or said == "e":
        return "", None
    if said == "s":
        text = texts[int(raw)]
        return text, "texto" if text else None
    if said == "str":
        return raw, "texto"
    if said == "b":
        return ("True" if raw == "1" else "False"), "logico"
    if said == "d":
        return _moment_text(dt.datetime.fromisoformat(raw)), "fecha"
    style = int(style)
    kind = kinds[style] if style < len(kinds) else "numero"
    x = float(raw)
    if kind == "numero":
        return (str(int(x)) if x.is_integer() else repr(x)), kind
    moment = epoch + dt.timedelta(seconds=round(x * 86400))
    if kind == "hora" and 0 <= x < 1:
        return moment.strftime("%H:%M:%S"), "hora"
    return _moment_text(moment), "fecha"


def _moment_text(moment: dt.datetime) -> str:
    midnight = moment.time() == dt.time()
    return moment.strftime("%Y-%m-%d" if midnight else "%Y-%m-%d %H:%M:%S")
