"""Workbooks as a source, and reports as one named file each."""

import os
import zipfile

import pytest

from ventanilla.sources import named_files, reports, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows_xml, shared=(), formats=(), codes=(), props="", open_tag=f"<worksheet {MAIN}><sheetData>",
             close_tag="</sheetData><pageMargins left='1'/></worksheet>"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}">{props}<sheets><sheet name="A" sheetId="1" r:id="rId7"/>'
                                      '<sheet name="B" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId8" Target="worksheets/b.xml"/>'
                                                 '<Relationship Id="rId7" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {MAIN}><numFmts>" + "".join(f'<numFmt numFmtId="{i}" formatCode="{c}"/>' for i, c in codes)
                   + "</numFmts><cellXfs>" + "".join(f'<xf numFmtId="{f}"/>' for f in formats) + "</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/a.xml", '<?xml version="1.0" encoding="UTF-8"?>' + open_tag + rows_xml + close_tag)


def read(spark, folder, **kw):
    got = sheets.read_sheets(sheets.sheet_files(spark, str(folder)), **kw).collect()
    return sorted(((r.nombre_archivo, r.row_no, r.cells, r.tipos, r.motivo) for r in got), key=repr)


def test_typed_cells(spark, tmp_path):
    workbook(tmp_path / "t ñ%20.xlsx",
             '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>260</v></c><c r="D2"><v>0.5</v></c><c r="AA2" t="b"><v>1</v></c></row>'
             '<row r="5"><c s="1"><v>46084</v></c><c s="1"><v>46084.5</v></c><c s="2"><v>0.25</v></c><c s="3"><v>0.75</v></c>'
             '<c t="e"><v>#N/A</v></c><c t="s"><v>1</v></c><c t="str"><v>f</v></c></row><row><c t="inlineStr"><is><t>x &lt;row r="9"&gt;</t></is></c></row>',
             shared=["<t>uno</t>", "<r><t>do</t></r><r><t>s</t></r><rPh><t>no</t></rPh>"], formats=[0, 14, 20, 170],
             codes=[(170, "[h]:mm:ss;@")])
    got = read(spark, tmp_path)
    name = "t ñ%20.xlsx"
    assert got == sorted([
        (name, 2, ["uno", "", "260", "0.5"] + [""] * 22 + ["True"], ["texto", None, "numero", "numero"] + [None] * 22 + ["logico"], None),
        (name, 5, ["2026-03-03", "2026-03-03 12:00:00", "06:00:00", "18:00:00", "", "dos", "f"],
         ["fecha", "fecha", "hora", "hora", None, "texto", "texto"], None),
        (name, 6, ['x <row r="9">'], ["texto"], None)], key=repr)


def test_1904_dates_and_prefixed_tags(spark, tmp_path):
    workbook(tmp_path / "m.xlsx", '<x:row r="1"><x:c r="A1" s="0"><x:v>1</x:v></x:c></x:row><x:row r="2"/>', formats=[14],
             props='<workbookPr date1904="1"/>', open_tag=f"<x:worksheet {MAIN.replace('xmlns', 'xmlns:x')}><x:sheetData>",
             close_tag="</x:sheetData></x:worksheet>")
    assert [r[1:4] for r in read(spark, tmp_path)] == [(1, ["1904-01-02"], ["fecha"]), (2, [], [])]


@pytest.mark.parametrize("block", [1, 37, 400, 1 << 20])
@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_blocks_give_every_row_once(spark, tmp_path, block, chunk):
    # numbers stand on every third row only; the others follow the one before
    rows = "".join(f'<row{f" r=\'{i}\'" if i % 3 == 0 else ""} ht="3"><c t="inlineStr"><is><t>{"é" * (i % 11)}{i}</t></is></c></row>' for i in range(3, 33))
    workbook(tmp_path / "b.xlsx", rows)
    was = sheets.CHUNK
    sheets.CHUNK = chunk
    try:
        path = str(tmp_path / "b.xlsx")
        size = sheets.sheet_size(path)
        got = [r for a in range(0, size, block) for r in sheets.sheet_rows(path, a, a + block)]
    finally:
        sheets.CHUNK = was
    assert [(n, c) for n, c, _ in got] == [(i, ["é" * (i % 11) + str(i)]) for i in range(3, 33)]


@pytest.mark.parametrize("block", [1, 400, 1 << 20])
def test_a_sheet_is_inflated_once_for_all_blocks(spark, tmp_path, monkeypatch, block):
    rows = "".join(f'<row{f" r=\'{i}\'" if i % 3 == 0 else ""}><c t="inlineStr"><is><t>{i}</t></is></c></row>' for i in range(3, 33))
    workbook(tmp_path / "b.xlsx", rows)
    monkeypatch.setattr(sheets, "CHUNK", 64)
    blocks = list(sheets.sheet_blocks(str(tmp_path / "b.xlsx"), block))
    assert sum(len(b[3]) for b in blocks) <= sheets.sheet_size(str(tmp_path / "b.xlsx"))
    assert len(blocks) == (1 if block > 400 else len(blocks)) and (block > 400 or len(blocks) > 3)
    assert [(r[1], r[2]) for r in sorted(read(spark, tmp_path, block=block), key=lambda r: r[1])] == [(i, [str(i)]) for i in range(3, 33)]


def test_unreadable_and_empty_workbooks(spark, tmp_path):
    (tmp_path / "no.xlsx").write_text("not a workbook")
    (tmp_path / "cero.xlsx").write_bytes(b"")
    workbook(tmp_path / "nada.xlsx", "")
    workbook(tmp_path / "roto.xlsx", "<row r='1'><c r='A1'><v>1</v></c></row><row r='2'><c></row>")
    got = read(spark, tmp_path)
    assert [(r[0], r[1], r[4]) for r in got] == [
        ("no.xlsx", None, sheets.UNREADABLE), ("roto.xlsx", 1, None), ("roto.xlsx", None, sheets.UNREADABLE)]
    workbook(tmp_path / "bien.xlsx", "<row r='1'><c r='A1'><v>1</v></c></row>")
    whole = sheets.whole_files(sheets.read_sheets(sheets.sheet_files(spark, str(tmp_path)))).collect()
    assert [(r.nombre_archivo, r.cells) for r in whole] == [("bien.xlsx", ["1"])]
    os.mkdir(tmp_path / "vacia")
    assert read(spark, tmp_path / "vacia") == []


def test_workbook_rows_equal_text_exports(spark):
    from conftest import SF_SMALL
    from ventanilla.plans.file_queries import report_file_ingest, sheet_file_ingest
    a = report_file_ingest(spark, SF_SMALL).drop("nombre_archivo")
    b = sheet_file_ingest(spark, SF_SMALL).drop("nombre_archivo")
    assert a.count() == b.count() and a.select(sorted(a.columns)).exceptAll(b.select(sorted(b.columns))).count() == 0


def test_workbook_round_trip(spark, tmp_path):
    cells = [["a", "", "<&>\"'"], [], ["", " x ", "á\r\nb", "\x01z"]]
    rows = spark.createDataFrame([("t", "r", i + 1, c) for i, c in enumerate(cells)], "tipo string, reporte string, row_no bigint, cells array<string>")
    named_files.write_named(rows, str(tmp_path), ["row_no"], named_files.ReportSheet)
    assert [(r[1], r[2]) for r in read(spark, tmp_path)] == [(1, cells[0]), (2, []), (3, ["", " x ", "á\r\nb", "z"])]


ROWS = "tipo string, reporte string, funcionario string, n int, x double"


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names
                  if named_files.CONFIRMED not in d and not f.endswith(".crc"))


def test_one_named_csv_per_report(spark, tmp_path):
    rows = spark.createDataFrame([("sol", "b", "Ñ, \"q\"", 2, 0.1), ("sol", "a", "ANA", 1, 23.0), ("sol", "b", None, None, None),
                                  (None, "../x", "EVA", 3, 1.5)], ROWS)
    named_files.write_named(rows, str(tmp_path), ["funcionario"])
    assert files(tmp_path) == ["sin_nombre/.._x.csv", "sol/a.csv", "sol/b.csv"]
    assert (tmp_path / "sol" / "b.csv").read_bytes() == "﻿funcionario,n,x\n,,\n\"Ñ, \"\"q\"\"\",2,0.1\n".encode()
    assert not [d for d in os.listdir(tmp_path) if d.startswith(named_files.TRY)]
    assert reports.read_csv_report(spark, str(tmp_path / "sol" / "a.csv")).columns == ["funcionario", "n", "x"]


def test_a_taken_name_gets_the_time(spark, tmp_path):
    (tmp_path / "sol" / "a.csv").mkdir(parents=True)
    (tmp_path / "sol" / "b.csv").write_text("old")
    rows = spark.createDataFrame([("sol", "a", "ANA", 1, 1.0), ("sol", "b", "EVA", 2, 2.0)], ROWS)
    named_files.write_named(rows, str(tmp_path), ["funcionario"], taken=named_files.KEEP)
    assert (tmp_path / "sol" / "b.csv").read_text() == "old"
    named_files.write_named(rows, str(tmp_path), ["funcionario"])
    assert (tmp_path / "sol" / "b.csv").read_text(encoding="utf-8-sig") == "funcionario,n,x\nEVA,2,2.0\n"
    import re
    assert [re.sub(r"_\d{8}_\d{6}(_2)?", "_T", f) for f in files(tmp_path)] == ["sol/a_T.csv", "sol/a_T.csv", "sol/b.csv", "sol/b_T.csv"]


def test_a_failed_job_puts_nothing_in_place(spark, tmp_path):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("sol", "a", "ANA", 1, 1.0), ("sol", "b", "EVA", 2, 2.0)], ROWS)
    bad = rows.withColumn("n", F.when(F.col("reporte") == "b", F.raise_error(F.lit("dies"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception):
        named_files.write_named(bad, str(tmp_path), ["funcionario"])
    assert files(tmp_path) == []


def test_reports_whose_names_collide_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("sol", "a/b", "ANA", 1, 1.0), ("sol", "a_b", "EVA", 2, 2.0)], ROWS)
    with pytest.raises(Exception, match="written twice"):
        named_files.write_named(rows, str(tmp_path), ["funcionario"])
    assert files(tmp_path) == []


def test_no_rows_give_no_files(spark, tmp_path):
    named_files.write_named(spark.createDataFrame([], ROWS), str(tmp_path), ["funcionario"])
    assert files(tmp_path) == []
