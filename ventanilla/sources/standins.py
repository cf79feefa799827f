"""Stand-in inputs built from the given tables.

The test tables hold no service-desk reports, so each function here only
reshapes a given table into rows of the schema a job expects (report cells
as text, catalog rows, roster rows). No cleaning, parsing, dedup or metric
is computed here: that is the library's work on these rows.

SOL report rows  <- events   (one event = one handled application)
CR report rows   <- lineitem (one line = one card delivery)
file catalog     <- orders
roles / users    <- nation / supplier
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventanilla.functions.columns import idiv
from ventanilla.sources.tables import table

SOL_HEADERS = ["TERMINAL", "SOLICITUD", "FECHA DE TRAMITE", "TIPO DE TRAMITE",
               "NOMBRE FUNCIONARIO", "DOMICILIO VISIBLE", "HORA INICIO ATENCIÓN",
               "HORA FIN ATENCIÓN", "TIEMPO TOTAL DE ATENCIÓN"]

CR_HEADERS = ["TERMINAL", "SOLICITUD", "FECHA DE ENTREGA", "FOLIO NEC",
              "HORA INICIO ATENCIÓN", "CAPTURA TRAMITE_HORA INICIO", "HORA FIN",
              "TIEMPO TOTAL DE CAPTURA", "TIEMPO TOTAL DE ATENCIÓN"]


def _lp2(c):
    return F.lpad(c.cast("string"), 2, "0")


def _dmy(ts):
    return F.concat(_lp2(F.dayofmonth(ts)), F.lit("/"), _lp2(F.month(ts)), F.lit("/"),
                    F.year(ts).cast("string"))


def _hms_text(secs):
    return F.concat(idiv(secs, F.lit(3600)).cast("string"), F.lit(":"),
                    _lp2(idiv(secs % 3600, F.lit(60))), F.lit(":"), _lp2(secs % 60))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all shuffle partitions: the given tables are one row group each, report files are many splits."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _sol_file() -> tuple[Column, Column]:
    """The report file of an event: its id, and whether it is of the first office."""
    day, user = F.dayofmonth("ts"), F.col("user_id")
    file_id = F.lit(2) * F.when(day <= 20, day).otherwise(F.lit(100) + idiv(day, F.lit(7))) + user % 2
    return file_id.cast("bigint"), F.coalesce(user % 2 == 0, F.lit(False))


def _cr_file() -> tuple[Column, Column]:
    """The report file of an order line: its id, and whether it is of the first office."""
    supplier = F.col("l_suppkey")
    return (F.lit(1000) + supplier % 40).cast("bigint"), F.coalesce(supplier % 2 == 0, F.lit(False))


def _file_name(kind: str, file_id: Column, first_office: Column) -> Column:
    office = F.when(first_office, F.lit("090852")).otherwise(F.lit("090853"))
    return F.concat(F.lit(f"Rep_TiemAten_{kind}_"), office, F.lit("_"), file_id.cast("string"), F.lit(".xls"))


def _file_names(rows: DataFrame, kind: str, file_id: Column, first_office: Column) -> DataFrame:
    """The report files of some rows; a file's name is made once, not for each of its rows."""
    files = rows.select(file_id.alias("archivo_id"), first_office.alias("primera")).distinct()
    return files.select("archivo_id", _file_name(kind, F.col("archivo_id"), F.col("primera")).alias("nombre_archivo"))


def sol_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of SOL report files as the sheet reader yields them: text cells
    under the flattened header names, plus file name, file id and row number."""
    e = _dealt(table(spark, sf_dir, "events"), "event_id")
    file_id, first_office = _sol_file()
    secs = F.floor(F.col("value") * 15).cast("bigint")
    bad_time = F.col("event_id") % 11 == 0
    return e.select(
        file_id.alias("archivo_id"), _file_name("SOL", file_id, first_office).alias("nombre_archivo"),
        F.col("event_id").alias("row_no"),
        F.when(F.col("event_id") % 1009 == 0, F.lit("TERMINAL"))
         .when(F.col("event_id") % 29 == 0, F.lit(None).cast("string"))
         .when(F.col("event_id") % 7 == 0, F.lit(" "))
         .otherwise(F.concat(F.lit("CLIENTE "), (F.col("event_id") % 6 + 1).cast("string")))
         .alias("TERMINAL"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("S"), (F.col("event_id") % 5).cast("string"))).alias("SOLICITUD"),
        F.when(F.col("event_id") % 997 == 0, F.lit("sin fecha")).otherwise(_dmy(F.col("ts")))
         .alias("FECHA DE TRAMITE"),
        F.when(F.col("event_type") == "purchase", F.lit(" Entrega de credencial "))
         .when(F.col("event_type") == "signup", F.lit("Inscripción"))
         .when(F.col("event_type") == "view", F.lit("Reposición"))
         .when(F.col("event_type") == "click", F.lit("Cambio de domicilio"))
         .alias("TIPO DE TRAMITE"),
        F.when(F.col("user_id") % 50 == 49, F.lit(None).cast("string"))
         .when(F.col("user_id") % 50 == 48, F.lit("nan"))
         .otherwise(F.concat(F.lit("F"), F.col("user_id").cast("string"))).alias("NOMBRE FUNCIONARIO"),
        F.when(F.col("user_id") % 3 == 0, F.lit("SI")).when(F.col("user_id") % 3 == 1, F.lit("NO"))
         .alias("DOMICILIO VISIBLE"),
        F.date_format("ts", "HH:mm:ss").alias("HORA INICIO ATENCIÓN"),
        F.when(bad_time, F.lit(None).cast("string"))
         .otherwise(F.date_format(F.timestamp_add("SECOND", secs, F.col("ts")), "HH:mm:ss"))
         .alias("HORA FIN ATENCIÓN"),
        F.when(bad_time, F.lit("x")).otherwise(_hms_text(secs)).alias("TIEMPO TOTAL DE ATENCIÓN"),
    )


def cr_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CR report files (text cells under the flattened headers)."""
    li = _dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    file_id, first_office = _cr_file()
    secs = (F.col("l_quantity") * 30).cast("bigint")
    return li.select(
        file_id.alias("archivo_id"), _file_name("CR", file_id, first_office).alias("nombre_archivo"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("CLIENTE "), (F.col("l_suppkey") % 6 + 1).cast("string")))
         .alias("TERMINAL"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit("nan"))
         .otherwise(idiv(F.col("l_orderkey"), F.lit(20)).cast("string")).alias("SOLICITUD"),
        _dmy(F.col("l_shipdate")).alias("FECHA DE ENTREGA"),
        F.concat(F.lit("NEC"), F.col("l_orderkey").cast("string")).alias("FOLIO NEC"),
        F.concat(_lp2(F.col("l_linenumber") + 8), F.lit(":"), _lp2(F.col("l_partkey") % 60),
                 F.lit(":00")).alias("HORA INICIO ATENCIÓN"),
        F.concat(_lp2(F.col("l_linenumber") + 8), F.lit(":"), _lp2(F.col("l_partkey") % 60),
                 F.lit(":30")).alias("CAPTURA TRAMITE_HORA INICIO"),
        F.concat(_lp2(F.col("l_linenumber") + 9), F.lit(":"), _lp2(F.col("l_partkey") % 60),
                 F.lit(":00")).alias("HORA FIN"),
        _hms_text(secs % 600).alias("TIEMPO TOTAL DE CAPTURA"),
        F.when(F.col("l_linenumber") == 7, F.lit("--")).otherwise(_hms_text(secs))
         .alias("TIEMPO TOTAL DE ATENCIÓN"),
    )


def _catalog_columns():
    office_txt = (F.when(F.col("o_custkey") % 3 == 0, F.lit("090852"))
                  .when(F.col("o_custkey") % 3 == 1, F.lit("090853")).otherwise(F.lit("000000")))
    kind = (F.when(F.col("o_orderstatus") == "F", F.lit("SOL_"))
            .when(F.col("o_orderstatus") == "O", F.lit("CR_")).otherwise(F.lit("X_")))
    prio = F.substring("o_orderpriority", 1, 1)
    return [
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Rep_TiemAten_"), kind, office_txt, F.lit("_"),
                 F.col("o_orderkey").cast("string"), F.lit(".xls")).alias("nombre_archivo"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("090852"))
         .when(F.col("o_custkey") % 3 == 1, F.lit("090853")).otherwise(F.lit("DESCONOCIDO")).alias("mac"),
        F.when(F.col("o_orderstatus") == "F", F.lit("TIEMPOS_SOL"))
         .when(F.col("o_orderstatus") == "O", F.lit("TIEMPOS_CR")).otherwise(F.lit("TIEMPOS")).alias("tipo"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit("ERROR"))
         .when(F.col("o_orderkey") % 10 == 1, F.lit("PENDIENTE")).otherwise(F.lit("PROCESADO")).alias("estatus"),
        (F.col("o_orderkey") % 23 != 0).alias("activo"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("date"))
         .otherwise(F.col("o_orderdate").cast("date")).alias("fecha_operativa"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("fecha_carga"),
        F.when(prio == "1", F.lit("DIARIO")).when(prio == "2", F.lit("SEMANAL")).alias("tipo_periodo"),
    ]


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the uploaded-file catalog (one per order)."""
    return table(spark, sf_dir, "orders").select(*_catalog_columns())


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nombre"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("username"),
        F.concat(F.lit("Usuario "), F.col("s_suppkey").cast("string")).alias("nombre_completo"),
        F.col("s_nationkey").cast("bigint").alias("role_id"),
        (F.col("s_suppkey") % 9 != 0).alias("activo"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("090852"))
         .when(F.col("s_suppkey") % 3 == 1, F.lit("090853")).alias("mac_asignado"),
    )


def cr_clerk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a legacy per-clerk CR report (columns as read from its CSV)."""
    s = table(spark, sf_dir, "supplier")
    n = (F.col("s_suppkey") * 7) % 40
    return s.select(
        F.when(F.col("s_suppkey") % 50 == 49, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("F"), F.col("s_suppkey").cast("string"))).alias("funcionario"),
        F.when(F.col("s_suppkey") % 13 == 0, F.lit("n/a")).otherwise(n.cast("string")).alias("entregas"),
        F.when(n == 0, F.lit(None).cast("string"))
         .otherwise(_hms_text(F.col("s_suppkey") * 11 % 1800)).alias("promedio_tiempo"),
        _hms_text(F.col("s_suppkey") % 300).alias("tiempo_minimo"),
        _hms_text(F.col("s_suppkey") % 300 + 900).alias("tiempo_maximo"),
        (F.col("s_suppkey") % 4).cast("string").alias("atipicos"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload attempts: file name, the uploader's role and office, expected type."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        _catalog_columns()[1],
        (F.col("o_custkey") % 5).alias("role_id"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("string"))
         .when(F.col("o_custkey") % 2 == 0, F.lit("090852")).otherwise(F.lit("090853")).alias("mac_usuario"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string"))
         .when(F.col("o_orderkey") % 3 == 1, F.lit("TIEMPOS_SOL")).otherwise(F.lit("TIEMPOS_CR"))
         .alias("tipo_esperado"),
    )


def report_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload of every report file: uploader's role and office, expected kind and load time."""
    names = (_file_names(table(spark, sf_dir, "events"), "SOL", *_sol_file())
             .unionByName(_file_names(table(spark, sf_dir, "lineitem"), "CR", *_cr_file())).distinct())
    a, name = F.col("archivo_id"), F.col("nombre_archivo")
    own = F.when(name.contains("090852"), F.lit("090852")).otherwise(F.lit("090853"))
    kind = F.when(name.contains("_SOL_"), F.lit("TIEMPOS_SOL")).otherwise(F.lit("TIEMPOS_CR"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return names.select(
        "archivo_id", "nombre_archivo", F.when(a % 4 == 0, 1).otherwise(2).cast("bigint").alias("role_id"),
        F.when(a % 9 == 0, F.lit(None).cast("string")).when(a % 11 == 0, F.lit("090852")).otherwise(own).alias("mac_usuario"),
        F.when(a % 3 == 0, F.lit(None).cast("string")).when(a % 13 == 0, F.lit("TIEMPOS_CR")).otherwise(kind).alias("tipo_esperado"),
        F.timestamp_add("HOUR", (a * 37 % 1000).cast("int"), start).alias("fecha_carga"))
