"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import id_and_text, schema

#: Kinds in report order; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs and the look-behind only stop a retry inside a digit run, where
# no match can start; the matches are those of the plain patterns.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a confirmed span before its context is seen.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
#: Words near a span that raise its score by 0.2, and words that lower it by 0.2.
FOR = {
    "email": re.compile(r"e-?mail|contact|write|@"), "ip": re.compile(r"\bip\b|address|host|server|login"),
    "card": re.compile(r"card|visa|credit|debit|payment|mastercard"),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|whatsapp"),
    "iban": re.compile(r"iban|account|bank|transfer"), "ssn": re.compile(r"\bssn\b|social|security"),
}
AGAINST = {
    "ip": re.compile(r"version|release|section|chapter"), "card": re.compile(r"order|invoice|isbn|serial|tracking"),
    "phone": re.compile(r"version|isbn|serial"), "ssn": re.compile(r"part|model|serial|order|phone"),
}
#: Characters on each side that count as context; least score of the added kinds.
NEAR, LEAST = 40, 0.5


def luhn(digits: str) -> bool:
    """Luhn check: every second digit from the right doubled, digit sums added, divisible by ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97: first four characters moved to the end, letters as 10..35, remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern in linear time: each ``@`` is extended to both sides."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive.

    Base kinds are reported whenever their pattern and check hold; the added
    kinds also need a score of at least ``LEAST``.
    """
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    for m in _IBAN.finditer(text):
        # the account may be followed by other capitals; the longest prefix that passes is taken
        s = m[0]
        for end in range(len(s), 14, -1):
            part = s[:end].replace(" ", "")
            if 15 <= len(part) <= 34 and s[end - 1] != " " and mod97(part):
                found.append(("iban", m.start(), m.start() + end))
                break
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)
              if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    out = []
    for kind, s, e in found:
        near = (text[max(0, s - NEAR):s] + " " + text[e:e + NEAR]).lower()
        score = PRIOR[kind] + 0.2 * bool(FOR[kind].search(near)) - 0.2 * bool(kind in AGAINST and AGAINST[kind].search(near))
        score = min(1.0, max(0.0, score))
        if kind in BASE_KINDS or score >= LEAST:
            out.append((kind, s, e, round(score, 3)))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by ``<KIND>``; of overlapping spans the earlier, then longer, stands."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, spans array<struct<kind,start,end,score>>``.

    Null text counts as empty (no spans); a null id is kept; repeated rows
    are each searched; an empty table gives no rows; other columns are not
    read. Each document is searched whole, in time linear in its length.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t)]
                   for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, schema("doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by ``<KIND>``; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                clean = [None if t is None else redact(t, find_spans(t)) for t in b.column(at).to_pylist()]
                cols = [b.column(i) for i in range(b.num_columns)]
                cols[at] = pa.array(clean, b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """The spans of ``pii_spans`` as counts and digests, one row per document."""
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return pii_spans(docs).select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
