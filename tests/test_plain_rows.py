"""Blocks of a sheet read at once against the parser, and what tasks are given."""

import io
import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from ventanilla.sources import arrivals, named_files, sheets

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
HEAD = f'<worksheet xmlns="{MAIN}" xmlns:q="urn:q">'.encode()
CELL = '<c r="A{n}" s="1" t="inlineStr"><is><t xml:space="preserve">x{n}</t></is></c><c r="C{n}"><v>{n}</v></c>'


def cell(said, style, raw):
    return sheets._cell(said, style, raw, ["numero", "fecha", "hora"], ["uno", "", "tres & x"], sheets.dt.datetime(1899, 12, 30))


def parsed(xml, head=HEAD):
    return list(sheets._rows_of(io.BytesIO(head + xml.encode()), 0, sys.maxsize, cell, 4))


def at_once(xml, head=HEAD):
    got = sheets._plain_block(xml.encode(), head, 4, cell)
    return None if got is None else list(zip(*[c.to_pylist() for c in got], strict=True))


@pytest.mark.parametrize("xml", [
    '<row r="7" spans="1:9" q:d="0.25"><c r="A7" t="s" s="2"><v>2</v></c><c r="AB7"><f>A1+1</f><v>1.50</v></c></row><row/><row r="12"></row>',
    '<sheetViews/><sheetData>\r\n <row>\n <c><v>1</v></c> <c t="b"><v>1</v></c><c t="str"><v> a\r\nb </v></c><c t="e"><v>#N/A</v></c></row></sheetData><z>',
    '<row r="1"><c r="B1" t="inlineStr"><is><t>ñ &amp; &lt;row r="9"&gt;&#13;€</t></is></c><c r="C1" t="inlineStr"><v>1</v></c><c r="D1"/></row>',
    '<row r="1"><c r="A1" s="1"><v>46084.5</v></c><c r="B1" s="2"><v>0.25</v></c><c r="C1" s="9"><v>-3.0</v></c><c r="D1" t="s"><v/></c>'
    '<c r="E1"><f t="shared" si="0"/></c><c r="F1" t="inlineStr"><is/></c><c r="G1" t="d"><v>2026-03-03T00:00:00</v></c></row>',
    "".join(f'<row r="{n}">{CELL.format(n=n)}</row>' for n in range(1, 40))])
def test_plain_blocks_are_read_as_by_the_parser(xml):
    assert at_once(xml) == parsed(xml) != []


def test_prefixed_tags_are_plain():
    head = f'<x:worksheet xmlns:x="{MAIN}">'.encode()
    xml = '<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c></x:row>'
    assert at_once(xml, head) == parsed(xml, head) == [(1, ["uno"], ["texto"])]


@pytest.mark.parametrize("inner", ['<c r="A1"><v>1<!-- n --></v></c>', '<c r="A1" t="str"><v><![CDATA[a]]></v></c>', '<c r="A1" t="str"><v>a>b</v></c>',
                                   '<c r="B1"><v>1</v></c><c r="A1"><v>2</v></c>', '<c s="1" r="C1"><v>1</v></c>', '<c r="A1"><v>1</v></c><z/>',
                                   '<c r="A1" t="inlineStr"><is><r><rPr/><t>do</t></r><r><t>s</t></r></is></c>', "<c r='A1'><v>1</v></c><c><v>2</v></c>"])
def test_other_blocks_are_left_to_the_parser(inner):
    xml = f'<row r="1">{inner}</row>'
    assert at_once(xml) is None and len(parsed(xml)) == 1


@pytest.mark.parametrize("xml", ["<row><c></row>", '<row><c r="A1"x><v>1</v></c></row>', "<row><c><v>&no;</v></c></row>", "<row><c><v>abc</v></c></row>",
                                 '<row><c t="s"><v>9</v></c></row>', "<row><c><v>\x01</v></c></row>", "<row><c u:t='s'><v>1</v></c></row>"])
def test_faults_are_found_as_by_the_parser(xml):
    good = '<row r="5"><c r="A5"><v>1</v></c></row>'
    assert at_once(good + xml) is None
    rows = []
    with pytest.raises(sheets.WORKBOOK_ERRORS):
        for r in sheets._rows_of(io.BytesIO(HEAD + (good + xml).encode()), 0, sys.maxsize, cell, 4):
            rows.append(r)
    assert rows == [(5, ["1"], ["numero"])]


def _calls(f):
    n = 0

    def count(*_):
        nonlocal n
        n += 1
    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_work_in_python_does_not_grow_with_cells():
    few, many = ["".join(f'<row r="{n}">{CELL.format(n=n)[:-len(f"<v>{n}</v></c>")]}<v>7</v></c></row>' for n in range(1, k)) for k in (200, 2000)]
    assert at_once(few) == parsed(few)
    a, b = (_calls(lambda x=x: sheets._plain_block(x.encode(), HEAD, 0, cell)) for x in (few, many))
    assert b <= a + 50
    # written for many cells at once, too
    rows = [(pa.array(range(n)), pa.array([["a", "", "b"]] * n)) for n in (50, 900)]
    a, b = (_calls(lambda r=r: named_files.SheetFile(io.BytesIO(), ["row_no", "cells"]).add(r)) for r in rows)
    assert b <= a + 50


def test_tasks_need_not_have_this_package(tmp_path):
    def pickled():
        return sheets._rows_of, sheets._plain_block, sheets.sheet_blocks, named_files.ReportSheet
    (tmp_path / "f").write_bytes(cloudpickle.dumps(pickled()))
    code = "import pickle; assert len(pickle.load(open('f', 'rb'))) == 4"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    spark = os.path.dirname(os.path.dirname(sys.modules["pyspark"].__file__))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**env, "PYTHONPATH": spark}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_headers_and_columns_of_files_are_found_once(spark, tmp_path):
    rows = [[""] * 3, ["TERMINAL", "SOLICITUD", "TIEMPO TOTAL DE ATENCIÓN"], [""] * 3, ["T 1", "S1", "0:10:00"], ["T 2", "S2", "--"]]
    cells = spark.createDataFrame([(1, "Rep_TiemAten_CR_090852_1.xlsx", n, r) for n, r in zip([1, 16, 17, 18, 19], rows, strict=True)],
                                  "archivo_id bigint, nombre_archivo string, row_no bigint, cells array<string>")
    cells.write.parquet(str(tmp_path / "c"))
    got = arrivals.cr_rows_of_files(spark.read.parquet(str(tmp_path / "c")), apart=True)[0]
    # the reading of the rows names neither the headers' nor the columns' aggregation
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "bool_or" not in plan
    assert [(r.row_no, r.terminal, r.centesimas) for r in got.collect()] == [(18, "T 1", 1000)]
