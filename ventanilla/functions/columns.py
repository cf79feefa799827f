"""Scalar rules as Column expressions (all JVM-side, codegen friendly).

Exact arithmetic: minutes are kept as BIGINT hundredths, durations as
BIGINT microseconds; every rounding is done on integers so Spark and any
SQL engine agree bit for bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference's rules) -----------------------
# Office codes recognised in file names, in lookup order, and the fallback.
OFFICE_CODES = ["090852", "090853"]
UNKNOWN_OFFICE = "DESCONOCIDO"
# Report type from the upper-cased file name: first rule whose any token is
# contained wins; fallback OTRO.
REPORT_TYPE_RULES = [
    (["TIEMATEN_SOL", "_SOL_"], "TIEMPOS_SOL"),
    (["TIEMATEN_CR", "_CR_"], "TIEMPOS_CR"),
    (["TIEM", "ATEN"], "TIEMPOS"),
    (["TRAM"], "TRAMITES"),
    (["INVE"], "INVENTARIO"),
]
OTHER_REPORT_TYPE = "OTRO"
# Category of an application type text: first contained token wins.
CATEGORY_RULES = [
    ("ENTREGA", "ENTREGA"),
    ("INSCRIP", "INSCRIPCION"),
    ("REPOS", "REPOSICION"),
    ("DOMIC", "CAMBIO_DOMICILIO"),
    ("CORREC", "CORRECCION_DATOS"),
    ("REINCORP", "REINCORPORACION"),
    ("REEMPLAZO", "REEMPLAZO"),
]
DEFAULT_CATEGORY = "TRAMITE"
UNCLASSIFIED = "SIN_CLASIFICAR"
# Header names that may hold the application type, in priority order.
TYPE_COLUMN_CANDIDATES = ["TIPO DE TRAMITE", "TIPO DE TRÁMITE", "TRAMITE", "TRÁMITE"]
# Fixed outlier rule of the dashboards: strictly more than 15 minutes;
# within norm is 15 minutes or less.
NORM_MINUTES = 15
# Performance labels: fewer than 10 rows -> low volume; mean <= 13 min and
# outlier share <= 0.20 -> Alto; mean <= 15 min and share <= 0.35 -> Medio.
LABEL_MIN_ROWS = 10
LABEL_HIGH = (13, 20)     # (minutes, percent)
LABEL_MID = (15, 35)
LABEL_LOW_VOLUME, LABEL_ALTO, LABEL_MEDIO, LABEL_BAJO = "Bajo volumen", "Alto", "Medio", "Bajo"
# Presentation texts for missing values.
NO_DATA = "Sin datos"
NO_VALUE = "Sin dato"
NO_TERMINAL = "Sin terminal"
NO_REPORT = "Sin reporte"
ZERO_HMS = "00:00:00"
# Date layouts accepted for day-first dates (ISO read as ISO, see README).
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "yyyy-MM-dd"]
# Duration text: "H:MM:SS[.f]" optionally preceded by "N days ".
DURATION_PATTERN = r"^(?:(\d+) days? )?(\d+):(\d{2}):(\d{2})(?:\.(\d{1,9}))?$"
#: The same without days and fraction, as nearly all are written.
PLAIN_DURATION = r"^\d+:\d{2}:\d{2}$"
# ---------------------------------------------------------------------------

US_PER_SECOND = 1_000_000
US_PER_HUNDREDTH_MINUTE = 600_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.strip() removes (str.isspace), built from the rule.
PY_BLANKS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def _rare(c, rule) -> Column:
    """``rule`` of a text that seldom needs it, as a lambda.

    So it stays out of the method Spark generates for a row: several long rules
    in one make it too large for HotSpot to compile (8000 bytecodes)."""
    return F.get(F.transform(F.array(col_(c)), rule), F.lit(0))


def strip(c) -> Column:
    """Python-like strip: removes every Unicode blank at both ends.

    A char-set trim (no regex) that reads its input once, so a deep input
    expression is never duplicated."""
    return F.trim(col_(c), F.lit(PY_BLANKS))


def strip_cell(c) -> Column:
    """``strip`` of a plain column, which it names several times: text between visible
    ASCII characters has nothing to remove, the trim would look both ends up in all blanks."""
    s = col_(c)
    return F.when(_visible(s) & _visible(F.substring(s, -1, 1)), s).otherwise(strip(s))


def not_blank(c) -> Column:
    """True for text of which ``strip`` leaves something; one that starts with a visible character is not trimmed."""
    s = col_(c)
    return _visible(s) | (F.length(strip(s)) > 0)


def is_heading(c, heading: str) -> Column:
    """True for text that reads ``heading`` once stripped and upper-cased; only text that contains it is stripped."""
    s = col_(c)
    return F.upper(s).contains(heading) & (F.upper(strip(s)) == heading)


def _visible(s: Column) -> Column:
    """True for text that starts with one of the characters ``!`` to ``~``."""
    return (s >= "!") & (s < "\x7f")


def has_value(s) -> Column:
    """F11 test on stripped text: not null, not blank, not 'nan' (reads the input once)."""
    return ~F.lower(F.coalesce(col_(s), F.lit(""))).isin("", "nan")


def clean_stripped(s, default=None) -> Column:
    """F11 on already stripped text: null / blank / 'nan' -> default."""
    s = col_(s)
    dflt = F.lit(default) if not isinstance(default, Column) else default
    return F.when(s.isNull() | (s == "") | (F.lower(s) == "nan"), dflt).otherwise(s)


def clean_value(c, default=None) -> Column:
    """null / blank / 'nan' -> default, else the trimmed text."""
    s = strip(col_(c).cast("string"))
    dflt = F.lit(default) if not isinstance(default, Column) else default
    return F.when(col_(c).isNull() | (F.lower(s) == "nan") | (s == ""), dflt).otherwise(s)


def blank_to_null(c) -> Column:
    """P5: null or blank -> null, else trimmed."""
    return F.nullif(strip(col_(c)), F.lit(""))


def office_of(name) -> Column:
    """office code contained in a file name."""
    n = col_(name)
    expr = F.lit(UNKNOWN_OFFICE)
    for code in reversed(OFFICE_CODES):
        expr = F.when(n.contains(code), F.lit(code)).otherwise(expr)
    return expr


def report_type_of(name) -> Column:
    """report type from the upper-cased file name."""
    u = F.upper(col_(name))
    expr = F.lit(OTHER_REPORT_TYPE)
    for tokens, label in reversed(REPORT_TYPE_RULES):
        cond = reduce(lambda a, b: a | b, [u.contains(t) for t in tokens])
        expr = F.when(cond, F.lit(label)).otherwise(expr)
    return expr


def normalized_type(c) -> Column:
    """Trim + upper; blank or NAN (also a missing cell) -> SIN_CLASIFICAR."""
    t = F.upper(strip(F.coalesce(col_(c).cast("string"), F.lit("nan"))))
    return F.when((t == "") | (t == "NAN"), F.lit(UNCLASSIFIED)).otherwise(t)


def normalized_stripped_type(s) -> Column:
    """normalized_type on already stripped text."""
    t = F.upper(F.coalesce(col_(s), F.lit("nan")))
    return F.when((t == "") | (t == "NAN"), F.lit(UNCLASSIFIED)).otherwise(t)


def category_of(c, rules=None) -> Column:
    """category by first contained token; rules list is a parameter."""
    return category_of_normalized(normalized_type(c), rules)


def category_of_normalized(t, rules=None) -> Column:
    """F4 on a normalized (trimmed, upper-cased) type text."""
    rules = rules or CATEGORY_RULES
    t = col_(t)
    expr = F.lit(DEFAULT_CATEGORY)
    for token, label in reversed(rules):
        expr = F.when(t.contains(token), F.lit(label)).otherwise(expr)
    return F.when(t == UNCLASSIFIED, F.lit(UNCLASSIFIED)).otherwise(expr)


def parse_date(c) -> Column:
    """day-first date text -> DATE; anything else -> NULL (pass stripped text)."""
    s = col_(c).cast("string")
    return F.coalesce(*[F.try_to_date(s, fmt) for fmt in DATE_FORMATS])


def duration_ok(c) -> Column:
    """True when the (stripped) text is a duration F6 accepts."""
    return col_(c).rlike(DURATION_PATTERN)


def duration_us(c) -> Column:
    """duration text -> BIGINT microseconds ('H:MM:SS[.f]', 'N days HH:MM:SS[.f]').

    A duration beyond BIGINT microseconds is NULL like any other bad text. One
    validating ``rlike``, a second one for texts with days or fractions; the parts
    are cut out by position, as Spark evaluates an expression inside ``when`` anew
    wherever it is named."""
    s = col_(c)
    part = [F.substring_index(s, ":", 1), F.substring_index(F.substring_index(s, ":", 2), ":", -1), F.substring_index(s, ":", -1)]
    hours, mins, secs = [x.try_cast("bigint") for x in part]
    total = F.try_add(F.try_multiply(F.try_add(F.try_multiply(hours, F.lit(3600)), mins * 60), F.lit(US_PER_SECOND)), secs * US_PER_SECOND)
    return F.when(s.rlike(PLAIN_DURATION), total).otherwise(_rare(s, _duration_us))


def _duration_us(s: Column) -> Column:
    head = F.substring_index(s, ":", 1)
    days = F.when(head.contains(" "), F.substring_index(head, " ", 1).try_cast("bigint")).otherwise(F.lit(0))
    hours = F.substring_index(head, " ", -1).try_cast("bigint")
    mins = F.substring_index(F.substring_index(s, ":", 2), ":", -1).try_cast("bigint")
    secs = F.substring_index(s, ":", -1)
    secs_us = F.when(secs.contains("."), (secs.try_cast("decimal(18,6)") * US_PER_SECOND).cast("bigint")).otherwise(secs.try_cast("bigint") * US_PER_SECOND)
    whole_hours = F.try_add(F.try_multiply(days, F.lit(24)), hours)
    whole = F.try_add(F.try_multiply(whole_hours, F.lit(3600)), F.try_multiply(mins, F.lit(60)))
    total = F.try_add(F.try_multiply(whole, F.lit(US_PER_SECOND)), secs_us)
    return F.when(duration_ok(s), total)


def idiv(a, b) -> Column:
    """Exact integer division (SQL ``a div b``), truncating toward zero."""
    return F.call_function("div", col_(a), col_(b))


def div_half_even(a, b) -> Column:
    """round(a / b) with ties to even, for a >= 0, b > 0 (Python round)."""
    a, b = col_(a), col_(b)
    q = idiv(a, b)
    r = a - q * b
    return (F.when(r * 2 > b, q + 1)
            .when(r * 2 == b, q + q % 2)
            .otherwise(q))


def div_half_up(a, b) -> Column:
    """round(a / b) with ties away from zero, for a >= 0, b > 0 (SQL ROUND)."""
    a, b = col_(a), col_(b)
    return idiv(a * 2 + b, b * 2)


def hundredths_of_us(us) -> Column:
    """F8: minutes rounded to 2 places, as BIGINT hundredths."""
    return div_half_even(col_(us), F.lit(US_PER_HUNDREDTH_MINUTE))


def hms(seconds) -> Column:
    """Whole seconds -> 'HH:MM:SS' (hours may exceed 24)."""
    s = col_(seconds)
    return F.format_string("%02d:%02d:%02d", idiv(s, F.lit(3600)),
                           idiv(s % 3600, F.lit(60)), (s % 60).cast("bigint"))


def hundredths_to_hms(h, null_text=NO_DATA) -> Column:
    """minutes (hundredths) -> 'HH:MM:SS'; null -> null_text."""
    h = col_(h)
    secs = div_half_even(h * 3, F.lit(5))
    return F.when(h.isNull(), F.lit(null_text)).otherwise(hms(secs))


def mean_hundredths_to_hms(total_h, n, null_text=NO_DATA) -> Column:
    """F10 on an unrounded mean sum/n of hundredths (exact, ties to even)."""
    total_h, n = col_(total_h), col_(n)
    secs = div_half_even(total_h * 3, n * 5)
    return F.when(total_h.isNull() | (n == 0), F.lit(null_text)).otherwise(hms(secs))


def rounded_mean_hundredths(total_h, n) -> Column:
    """ROUND(AVG(minutes), 2) as hundredths: exact, half away from zero."""
    total_h, n = col_(total_h), col_(n)
    return F.when(n > 0, div_half_up(total_h, n))


def timedelta_hms(us, null_text="") -> Column:
    """F9 on a duration: seconds truncated, whole days dropped."""
    us = col_(us)
    secs = idiv(us, F.lit(US_PER_SECOND)) % 86400
    return F.when(us.isNull(), F.lit(null_text)).otherwise(hms(secs))


def timedelta_text_hms(c) -> Column:
    """F9 on text: keep the 'HH:MM:SS' of '[N days ]HH:MM:SS[.f]'; 'Sin datos' -> ''."""
    s = strip(col_(c).cast("string"))
    core = F.when(s.contains("days") & (F.size(F.split(s, " ")) >= 3),
                  F.element_at(F.split(s, " "), 3)).otherwise(s)
    core = F.split(core, r"\.").getItem(0)
    return F.when(col_(c).isNull() | (s == "") | (F.lower(s) == "sin datos"), F.lit("")).otherwise(core)


def performance_label(n, mean_h, over) -> Column:
    """label from rows, rounded mean (hundredths, null = 0) and count > 15 min."""
    n, over = col_(n), col_(over)
    m = F.coalesce(col_(mean_h), F.lit(0))
    return (F.when(n < LABEL_MIN_ROWS, F.lit(LABEL_LOW_VOLUME))
            .when((m <= LABEL_HIGH[0] * 100) & (over * 100 <= n * LABEL_HIGH[1]), F.lit(LABEL_ALTO))
            .when((m <= LABEL_MID[0] * 100) & (over * 100 <= n * LABEL_MID[1]), F.lit(LABEL_MEDIO))
            .otherwise(F.lit(LABEL_BAJO)))


def within_norm(h) -> Column:
    """minutes <= 15, null stays null."""
    return col_(h) <= NORM_MINUTES * 100


def percent_hundredths(x, n) -> Column:
    """round(100 * x / n, 2) as hundredths (ties to even); 0 when n = 0."""
    x, n = col_(x), col_(n)
    return F.when(n > 0, div_half_even(x * 10000, n)).otherwise(F.lit(0).cast("bigint"))


def hundredths_to_double(h) -> Column:
    return col_(h) / F.lit(100.0)


def py_number_text(h) -> Column:
    """Text of a 2-decimal float as Python prints it: 7.0, 23.6, 23.66."""
    h = col_(h)
    whole = idiv(h, F.lit(100)).cast("string")
    cents = (h % 100).cast("bigint")
    return (F.when(cents == 0, F.concat(whole, F.lit(".0")))
            .when(cents % 10 == 0, F.concat(whole, F.lit("."), idiv(cents, F.lit(10)).cast("string")))
            .otherwise(F.concat(whole, F.lit("."), F.lpad(cents.cast("string"), 2, "0"))))


def fixed2_text(h) -> Column:
    """'%.2f' of a hundredths value."""
    h = col_(h)
    return F.concat(idiv(h, F.lit(100)).cast("string"), F.lit("."),
                    F.lpad((h % 100).cast("bigint").cast("string"), 2, "0"))


def ratio_text(num, den) -> Column:
    """num / den with 2 decimals; '0.00' when den = 0."""
    num, den = col_(num), col_(den)
    return F.when(den > 0, fixed2_text(div_half_even(num * 100, den))).otherwise(F.lit("0.00"))


def time_of_day_text(ts, null_text=NO_VALUE) -> Column:
    """P19: 'HH:mm:ss' of a timestamp, or null_text."""
    return F.coalesce(F.date_format(col_(ts), "HH:mm:ss"), F.lit(null_text))


def combine_date_time(d, t, t_us) -> Column:
    """date + time-of-day text -> TIMESTAMP_NTZ; null date or time -> null.

    ``t`` is the stripped text and ``t_us`` its duration parse (column
    references computed in an earlier projection): a 'H:MM:SS' offset is
    added to the date, otherwise the text is read as a clock time."""
    d, s, us = col_(d), col_(t), col_(t_us)
    offset = F.timestamp_add("MICROSECOND", us, d.cast("timestamp_ntz"))
    txt = F.concat_ws(" ", F.date_format(d, "yyyy-MM-dd"), s)
    read = _rare(txt, lambda x: F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd h:mm a")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd H:mm"))))
    free = F.to_timestamp_ntz(F.date_format(read, "yyyy-MM-dd HH:mm:ss"))
    return (F.when(us.isNotNull(), offset)
             .when(d.isNull() | ~has_value(s), F.lit(None).cast("timestamp_ntz"))
             .otherwise(free))


def base_name(name) -> Column:
    """file name without its last extension."""
    return F.regexp_replace(col_(name), r"\.[^.]*$", "")
