"""Line dedup: hashes range-partitioned and sorted, decisions streamed, kept lines as bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import id_and_text, known_id, real_id, schema, staged

#: Fixed values of the registered query.
MIN_CHARS, MIN_DOCS = 20, 3
_BLANK = " \t\n\x0b\x0c\r"
#: What a streamed row says: the line goes; it is decided later; this document holds a key of a partition's edge.
GONE, OPEN, HOLDER = 0, 1, 2


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2`` (128-bit hash of the key), document and line number of every line that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, doc, th, pos = [], [], [], [], []
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for i, line in enumerate(text.as_py().split("\n")):
                    key = line.strip(_BLANK)
                    if len(key) >= min_chars:
                        h = xxhash.xxh3_128_intdigest(key.encode().lower())
                        h1.append((h >> 64) - (1 << 63))
                        h2.append((h & (1 << 64) - 1) - (1 << 63))
                        doc.append(d)
                        th.append(t)
                        pos.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (h1, h2, doc, th)] + [pa.array(pos, pa.int32())],
                names=["h1", "h2", "doc", "th", "pos"])

    return docs.select("doc", "th", "text").mapInArrow(run, schema("h1 bigint, h2 bigint, doc bigint, th bigint, pos int"))


def _stream(min_docs: int):
    """Streams the ``(h1, h2, doc desc, pos)`` rows of a sorted partition.

    A run of one key starts with its largest document, which stays; once the
    run has ``min_docs`` documents, every row of another document is GONE, and
    until then only the rows of fewer than ``min_docs`` documents wait. A
    partition's first run may have begun in the one before, so its rows leave
    as OPEN; so do the waiting rows of its last run. The first ``min_docs``
    documents of these two runs leave as HOLDER and decide the OPEN rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]

        def put(state: int, rows) -> None:
            for row in rows:
                for col, v in zip(out, (state, *row), strict=True):
                    col.append(v)

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=["state", "h1", "h2", "doc", "th", "pos"])

        key, first = None, True
        held: list[tuple] = []  # the first row of each of the run's first min_docs documents
        wait: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != key:
                    if key is not None and first:
                        put(HOLDER, held)
                        first = False
                    key, held, wait = row[:2], [], []
                if len(held) < min_docs and (not held or held[-1][2] != row[2]):
                    held.append(row)
                    if len(held) == min_docs and not first:
                        put(GONE, [r for r in wait if r[2] != held[0][2]])
                        wait = []
                if first:
                    put(OPEN, [row])
                elif len(held) < min_docs:
                    wait.append(row)
                elif row[2] != held[0][2]:
                    put(GONE, [row])
                if len(out[0]) >= 20_000:
                    yield flush()
        put(HOLDER, held)
        put(OPEN, wait)
        yield flush()

    return run


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, th, bitmap``: the kept lines of every document that loses any.

    ``docs`` has ``doc`` (id, ``NULL_ID`` for null), ``th`` (hash of the text)
    and ``text``. A line is long enough with ``min_chars`` code points after
    stripping; its key goes where at least ``min_docs`` distinct ids hold it,
    except in the largest. ``bitmap`` is a zlib-compressed bit per line up to
    the last dropped one, 1 for kept; later lines are kept.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    told = staged(_line_rows(docs, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("h1", "h2", "doc", "th", "pos").mapInArrow(
                      _stream(min_docs), schema("state int, h1 bigint, h2 bigint, doc bigint, th bigint, pos int")), "lines")
    # at most two keys of each partition
    ends = (told.where(F.col("state") == HOLDER).groupBy("h1", "h2")
            .agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= min_docs))
    late = (told.where(F.col("state") == OPEN).join(F.broadcast(ends), ["h1", "h2"])
            .where(F.col("doc") != F.col("top")).select("doc", "th", "pos"))
    gone = told.where(F.col("state") == GONE).select("doc", "th", "pos").unionAll(late)
    lists = gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for lines in b.column(2):
                at = lines.values.to_numpy(zero_copy_only=False)
                keep = np.ones(int(at.max()) // 8 * 8 + 8, bool)  # whole bytes; lines past the last are kept
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())],
                                             names=["doc", "th", "bitmap"])

    return lists.mapInArrow(squeeze, schema("doc bigint, th bigint, bitmap binary"))


def kept_lines(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text of the kept lines joined by newlines, the number of lines, the number dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:len(lines)].tolist()
    kept = [x for x, k in zip(lines, keep) if k] + lines[len(keep):]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [known_id(f"`{id_col}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")]


def line_dedup_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``.

    Null text counts as empty (one empty line). Rows with the same id, and all
    rows with a null id, count as one document when documents are counted; a
    null id is below every other; repeated rows give the same row each; an
    empty table gives no rows; other columns are not read.
    """
    keyed = id_and_text(docs).select(*_keyed(docs, "doc_id", "text"))
    both = keyed.join(line_keep_bitmaps(keyed, min_chars, min_docs), ["doc", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_lines(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got], pa.string())],
                names=["doc", "n_lines", "n_dropped", "kept_sha256"])

    return both.select("doc", "text", "bitmap").mapInArrow(
        run, schema("doc bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")).select(
        real_id("doc").alias("doc_id"),
        "n_lines", "n_dropped", "kept_sha256")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with the repeated lines taken out of ``text``; a null text stays null."""
    keys = _keyed(docs, id_col, text_col)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*cols).alias("row")
    keyed = docs.select(row, keys[0], keys[1])
    maps = line_keep_bitmaps(docs.select(*keys), min_chars, min_docs)

    @F.pandas_udf("string")
    def cut(text, bitmap):
        return text.combine(bitmap, lambda t, m: t if t is None or m is None else kept_lines(t, m)[0])

    both = keyed.join(maps, ["doc", "th"], "left").select("row", cut(F.col(f"row.`{text_col}`"), "bitmap").alias("cut"))
    return both.select(*[F.col("cut").cast(docs.schema[c].dataType).alias(c) if c == text_col
                         else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


LINE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT r, keyed.doc_id, pos, line, top IS NOT NULL AND keyed.doc_id <> top AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
