"""Scalar rules (F1-F18) on the hand-worked fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from ventanilla.functions import columns as C


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_office_and_type(spark):
    assert one_col(spark, ["x_090853_y.xls", "foo.xls", "a090852b"], C.office_of) == ["090853", "DESCONOCIDO", "090852"]
    names = ["Rep_TiemAten_SOL_1.xls", "a_cr_b.xls", "TIEMPOS.xls", "tramites.xls", "inve.xls", "z.xls"]
    assert one_col(spark, names, C.report_type_of) == ["TIEMPOS_SOL", "TIEMPOS_CR", "TIEMPOS", "TRAMITES",
                                                       "INVENTARIO", "OTRO"]


def test_category(spark):
    vals = [" entrega ", "Inscripción", "Reposición", "Cambio de domicilio", "Corrección", "Reincorporación",
            "Reemplazo", "Otro", "  ", None, "nan", "Entrega por reposición"]
    assert one_col(spark, vals, C.category_of) == [
        "ENTREGA", "INSCRIPCION", "REPOSICION", "CAMBIO_DOMICILIO", "CORRECCION_DATOS", "REINCORPORACION",
        "REEMPLAZO", "TRAMITE", "SIN_CLASIFICAR", "SIN_CLASIFICAR", "SIN_CLASIFICAR", "ENTREGA"]


def test_parse_date(spark):
    got = one_col(spark, ["14/03/2026", "04/03/2026", "x", "2026-03-04", None], lambda c: C.parse_date(C.strip(c)))
    assert got == [dt.date(2026, 3, 14), dt.date(2026, 3, 4), None, dt.date(2026, 3, 4), None]


def test_duration_and_minutes(spark):
    vals = ["0:12:34", "1 days 02:00:00", "12:34", "x", " 0:00:01.5 ", None]
    us = one_col(spark, vals, lambda c: C.duration_us(C.strip(c)))
    assert us == [754_000_000, 93_600_000_000, None, None, 1_500_000, None]
    h = one_col(spark, vals, lambda c: C.hundredths_of_us(C.duration_us(C.strip(c))))
    assert h == [1257, 156000, None, None, 2, None]


def test_strip_unicode_blanks(spark):
    assert one_col(spark, ["  ab\t", "  ", None], C.strip) == ["ab", "", None]


def test_timedelta_text(spark):
    got = one_col(spark, ["0 days 00:12:23.4567", "1 days 02:00:00", "Sin datos", None], C.timedelta_text_hms)
    assert got == ["00:12:23", "02:00:00", "", ""]
    assert one_col(spark, [743_456_700, 93_600_000_000, None], C.timedelta_hms, "bigint") == ["00:12:23", "02:00:00", ""]


def test_minutes_to_hms(spark):
    assert one_col(spark, [1257, 156000, None], C.hundredths_to_hms, "bigint") == ["00:12:34", "26:00:00", "Sin datos"]
    assert one_col(spark, [None], lambda c: C.hundredths_to_hms(c, C.ZERO_HMS), "bigint") == ["00:00:00"]


def test_performance_label(spark):
    df = spark.createDataFrame([(9, 500, 0), (10, 1300, 2), (10, 1301, 2), (20, 1500, 7), (20, 1500, 8),
                                (10, None, 0)], "n bigint, m bigint, o bigint")
    got = [r[0] for r in df.select(C.performance_label("n", "m", "o")).collect()]
    assert got == ["Bajo volumen", "Alto", "Medio", "Medio", "Bajo", "Alto"]


def test_within_norm(spark):
    assert one_col(spark, [1500, 1501, None], C.within_norm, "bigint") == [True, False, None]


def test_rounding_helpers(spark):
    df = spark.createDataFrame([(1, 8), (1, 32), (5, 2), (7, 2), (0, 1)], "a bigint, b bigint")
    he = [r[0] for r in df.select(C.div_half_even(F.col("a") * 100, F.col("b"))).collect()]
    assert he == [12, 3, 250, 350, 0]          # 12.5 -> 12, 3.125 -> 3 (ties to even)
    hu = [r[0] for r in df.select(C.div_half_up(F.col("a") * 100, F.col("b"))).collect()]
    assert hu == [13, 3, 250, 350, 0]
    txt = [r[0] for r in df.select(C.ratio_text(F.col("a"), F.col("b"))).collect()]
    assert txt == ["0.12", "0.03", "2.50", "3.50", "0.00"]


def test_python_number_text(spark):
    assert one_col(spark, [2366, 700, 2360, 5], C.py_number_text, "bigint") == ["23.66", "7.0", "23.6", "0.05"]


def test_combine_date_time(spark):
    df = spark.createDataFrame([(dt.date(2026, 3, 4), "8:15:00"), (dt.date(2026, 3, 4), "8:15 AM"),
                                (None, "8:15:00"), (dt.date(2026, 3, 4), "nan")], "d date, t string")
    df = df.withColumn("us", C.duration_us("t"))
    got = [r[0] for r in df.select(C.combine_date_time("d", "t", "us")).collect()]
    assert got == [dt.datetime(2026, 3, 4, 8, 15), dt.datetime(2026, 3, 4, 8, 15), None, None]
