"""Report parsing at size: rules compile, cheap paths equal the general ones, upload names come from few rows."""

import re

from pyspark.sql import functions as F

from ventanilla.functions import columns as C
from ventanilla.operators import clean
from ventanilla.plans import views as V
from ventanilla.plans.store_queries import stored
from ventanilla.sources import standins
from ventanilla.sources.fact_store import Batch

from conftest import SF_SMALL

#: HotSpot leaves larger methods interpreted.
LARGEST = 8000


def test_generated_methods_are_small_enough_to_be_compiled(spark, tmp_path, capsys):
    cr, sol = standins.cr_report_rows(spark, SF_SMALL), standins.sol_report_rows(spark, SF_SMALL)
    for name, report, parse in [("cr", cr, lambda r: clean.cr_fact_projection(clean.clean_cr_report(r))),
                                ("sol", sol, lambda r: clean.sol_rows(clean.clean_sol_report(r)))]:
        report.write.parquet(str(tmp_path / name))
        parse(spark.read.parquet(str(tmp_path / name))).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < LARGEST, (name, sizes)


def test_cell_strip_equals_strip(spark):
    blanks = [" ", "\t", "\n", " ", "　", "\x1c", "\x85", " "]
    texts = ["", "a", "~", "!", "\x7f", "\x00", "ñ", "a b", "aé", "éa", "日", "😀", *blanks]
    texts += [a + t + b for t in ("x", "é", "x y", "\x7f") for a in ["", *blanks, "   "] for b in ["", *blanks, "　 \t"]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", C.strip_cell("t").alias("s"))
    assert [(r.t, r.s) for r in df.collect() if r.s != (None if r.t is None else r.t.strip())] == []


def test_plain_durations_equal_the_general_rule(spark):
    texts = ["0:00:00", "1:02:03", "01:02:03", "99:99:99", "000:00:01", "2562047788:00:54", "2562047789:00:00", "9" * 19 + ":00:00", "9" * 30 + ":00:00",
             "1 day 1:02:03", "2 days 01:02:03.5", "1:02:03.123456789", "0:00:99.9999999", "1:2:3", "-1:02:03", "x", "", "--", ":00:00", "1:02:03\n", "١:02:03"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", C.duration_us("t").alias("a"), C._duration_us(F.col("t")).alias("b"))
    rows = {r.t: (r.a, r.b) for r in df.collect()}
    assert {t: x for t, x in rows.items() if x[0] != x[1]} == {}
    assert rows["1:02:03"][0] == 3_723_000_000 and rows["2 days 01:02:03.5"][0] == 176_523_500_000 and rows["99:99:99"][0] is not None
    assert rows["2562047789:00:00"][0] is rows["x"][0] is rows[None][0] is None


def test_uploads_name_every_report_file_without_shuffling_its_rows(spark):
    rows = standins.sol_report_rows(spark, SF_SMALL).unionByName(standins.cr_report_rows(spark, SF_SMALL), allowMissingColumns=True)
    uploads = standins.report_uploads(spark, SF_SMALL)
    names = {tuple(r) for r in rows.select("archivo_id", "nombre_archivo").collect()}
    got = [tuple(r) for r in uploads.select("archivo_id", "nombre_archivo").collect()]
    assert len(got) == len(names) and set(got) == names
    assert "RepartitionByExpression" not in uploads._jdf.queryExecution().optimizedPlan().toString()


def test_row_filter_rules_equal_strip(spark):
    blanks = ["", " ", "\t", "　", "\x85", "  \n"]
    texts = [a + t + b for t in ("", "x", "é", "\x7f", "TERMINAL", "terminal", "termınal", "TERMINAL 1", "-TERMINAL") for a in blanks for b in blanks]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", C.not_blank("t").alias("n"), C.is_heading("t", "TERMINAL").alias("h"))
    for r in df.collect():
        assert (r.n, r.h) == ((None, None) if r.t is None else (r.t.strip() != "", r.t.strip().upper() == "TERMINAL")), repr(r.t)


def test_sorted_rows_hold_a_key_once_and_no_file_name(spark, monkeypatch):
    kept = {}
    keep = Batch.keep
    monkeypatch.setattr(Batch, "keep", lambda self, name, rows: kept.setdefault(name, keep(self, name, rows)))
    s = stored(spark, SF_SMALL)
    for name, table, own in [("sol", "tramites", V.sol_facts(spark, SF_SMALL)), ("cr", "entregas_cr", V.cr_facts(spark, SF_SMALL))]:
        fields = set(kept[name].schema["_first"].dataType.names)
        keys = {c.removeprefix("_k_") for c in kept[name].columns if c.startswith("_k_")}
        assert "archivo_id" in keys and not fields & (keys | {"nombre_archivo", "mac"})
        # the stored rows are those of reports parsed with names and keys, of the accepted uploads
        ids = s.table("arribos").where("motivo is null").select("archivo_id")
        want = own.join(ids, "archivo_id", "left_semi").select(*s.table(table).columns)
        assert want.count() and want.exceptAll(s.table(table)).count() == s.table(table).exceptAll(want).count() == 0
