"""Removal of repeated byte strings with suffix arrays by linear grouping.

A window of ``LENGTH`` bytes is filed under its smallest ``GRAM``-byte hash,
so equal windows meet whatever document they are in; consecutive windows with
one such hash travel as one string. Strings that occur twice are repeated as a
whole. Strings that share their gram but differ are told apart by a suffix
array of the group, built by grouping suffixes by their Lyndon prefixes.

Passages of ``WORDS`` words that another document has too are found beside it
in the same way, with words for bytes; their documents are told, nothing of
them is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import id_and_text, known_id, real_id, schema, staged

#: Fixed value of the registered query: bytes of a repeated string.
LENGTH = 400
#: Bytes of the gram under which windows are filed.
GRAM = 250
#: Words of a passage that is looked for in other documents, and of the gram under which it is filed.
WORDS = 51
WORD_GRAM = 16
#: A gram with more different strings is settled by hashes of its windows, not in one task.
MANY = 1000
#: Bytes hashed at a time.
PIECE = 1 << 20
#: Bytes of short documents hashed together.
CHUNK = 1 << 16

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BYTE = np.random.default_rng(5).integers(1, 2 ** 63, 256, np.int64).astype(np.uint64)


class Rolling:
    """Hashes of all substrings of a byte string, or of a row of hashes, from one prefix sum (mod 2**64)."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)
        self.text: bytes | np.ndarray | None = None

    def load(self, text: bytes | np.ndarray) -> None:
        if text is self.text:
            return
        self.text = text
        if len(self.up) < len(text):
            n = max(len(text), 1 << 14)
            step = np.full((2, n), [[_R], [_R_INV]], np.uint64)
            step[:, 0] = 1
            self.up, self.down = np.cumprod(step, axis=1, dtype=np.uint64)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        values = _BYTE[np.frombuffer(text, np.uint8)] if isinstance(text, bytes) else text
        np.cumsum(values * self.up[:len(text)], out=self.sums[1:])

    def hashes(self, start, end) -> np.ndarray:
        """Hash of ``text[start:end]``; start an array or slice of positions."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= _MUL
        h ^= h >> np.uint64(29)
        return h

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return self.hashes(slice(0, n), slice(size, size + n))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring values."""
    n = len(h) - w + 1
    pad = np.concatenate((h, np.full(-len(h) % w, np.uint64(2 ** 64 - 1))))
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


def word_hashes(text: bytes, ends: np.ndarray, roll: Rolling) -> tuple[np.ndarray, ...]:
    """``start, end, hash`` of every word ``[^\\x20\\x09-\\x0D]+`` of documents that lie one after another up to ``ends``."""
    b = np.frombuffer(text, np.uint8)
    inside = (b > 32) | (b < 9) | ((b > 13) & (b < 32))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(b))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(b) <= PIECE:
        roll.load(text)
        return start, end, roll.hashes(start, end)
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + PIECE, "right"))
        if j > i:
            roll.load(text[at:end[j - 1]])
            h[i:j] = roll.hashes(start[i:j] - at, end[i:j] - at)
        else:  # one word longer than a piece
            j = i + 1
            h[i] = xxhash.xxh3_64_intdigest(text[at:end[i]])
        i = j
    return start, end, h


def window_runs(text: bytes | np.ndarray, ends: np.ndarray, roll: Rolling, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``gram hash, string hash, start, windows`` of the runs of windows with one smallest gram.

    Documents lie one after another up to ``ends``; no window leaves its own.
    The gram of a window is the leftmost one with the smallest hash, so equal
    windows have theirs at the same place, and two windows of one run differ.
    """
    out: list[list] = [[], [], [], []]
    w = length - gram + 1
    cuts = np.concatenate((ends, ends - (length - 1)))
    for a in range(0, max(len(text) - length + 1, 0), PIECE):
        roll.load(text[a:a + PIECE + length - 1])
        h = roll.grams(gram)
        low = _sliding_min(h, w)
        new = np.concatenate(([True], low[1:] != low[:-1]))
        new[cuts[(cuts > a) & (cuts < a + len(low))] - a] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low)) - 1
        own = first + (a + length) <= ends[np.searchsorted(ends, first + a, "right")]
        first, last = first[own], last[own]
        if not len(first):
            continue
        at = first + np.lib.stride_tricks.sliding_window_view(h, w)[first].argmin(axis=1)
        again = np.flatnonzero(at < last)  # the gram itself comes again within the run
        if len(again):
            more = []
            for r in again.tolist():
                i, z = int(first[r]), int(last[r])
                p = np.flatnonzero(h[i:z + 1] == low[i]) + i + 1
                p = p[p <= z]
                more.append(np.stack((p, np.append(p[1:] - 1, z)[:len(p)])))
                if len(p):
                    last[r] = p[0] - 1
            add = np.concatenate(more, axis=1)
            first, last = np.concatenate((first, add[0])), np.concatenate((last, add[1]))
            order = np.argsort(first, kind="stable")
            first, last = first[order], last[order]
        size = last - first + 1
        whole = roll.hashes(first, first + size + (length - 1))
        for col, v in zip(out, (low[first].view(np.int64), whole.view(np.int64), first + a, size), strict=True):
            col.append(v)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in out)


def suffix_order(s: list[int]) -> list[int]:
    """Suffix array by linear grouping.

    First phase: groups of suffixes start as those with one first symbol and
    are taken from the highest down; each suffix of a group points to its
    previous smaller suffix (the last one before it in a lower group), and
    the suffixes pointed to move, by the number of pointers, to groups just
    above their own. Then a group holds the suffixes with one Lyndon prefix.
    Second phase: going up the order, each suffix found brings the one to its
    left, and along the pointers the ones before, to the front of its group.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for r, i in enumerate(order):
        if r and s[order[r - 1]] != s[i]:
            start = r
        place[i], group[i] = r, start
        size[start] += 1
    prev = [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        if end - g == 1:
            i = order[g]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            levels = ((1, (p,)),) if p >= 0 else ()
        else:
            hits: Counter = Counter()
            for i in sorted(order[g:end]):
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    hits[p] += 1
            by: dict[int, list[int]] = {}
            for p, k in hits.items():
                by.setdefault(k, []).append(p)
            levels = sorted(by.items(), reverse=True)
        for _, moved in levels:
            if len(moved) == 1:
                sets = {group[moved[0]]: moved}
            else:
                sets = {}
                for p in moved:
                    sets.setdefault(group[p], []).append(p)
            for old, some in sets.items():
                c, m = size[old], len(some)
                if m == c:
                    continue
                at = old + c
                new = at - m
                for p in some:
                    at -= 1
                    here, other = place[p], order[at]
                    order[here], order[at] = other, p
                    place[other], place[p] = here, at
                    group[p] = new
                size[old], size[new] = c - m, m
        end = g
    found = [-1] * n
    free = list(range(n))
    done = bytearray(n)
    i = n
    r = -1
    while True:
        j = i - 1
        while j >= 0 and not done[j]:
            g = group[j]
            found[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
        r += 1
        if r == n:
            return found
        i = found[r]


def repeated_windows(strings: list[tuple[bytes, bytes]], reach: int) -> list[list[int]]:
    """For strings ``left + gram + right`` of one gram: starts of the windows that another string has too.

    The gram counts as one symbol. A window starts at most ``reach`` bytes
    before it and takes ``reach + 1`` symbols; equal ones are neighbours in
    the suffix array.
    """
    s: list[int] = []
    begin = []
    for k, (left, right) in enumerate(strings):
        begin.append(len(s))
        s += left
        s.append(256)
        s += right
        s.append(257 + k)
    order = suffix_order(s)
    rank = [0] * len(s)
    for r, i in enumerate(order):
        rank[i] = r
    out = []
    for (left, right), b in zip(strings, begin, strict=True):
        hit = []
        for i in range(max(0, len(left) - reach), len(left) + 1):
            if len(left) - i + len(right) < reach:
                break
            at, r = b + i, rank[b + i]
            mine = s[at:at + reach + 1]
            for q in (r - 1, r + 1):
                if 0 <= q < len(s) and s[order[q]:order[q] + reach + 1] == mine:
                    hit.append(i)
                    break
        out.append(hit)
    return out


def _spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = a + length
        else:
            out.append([a, a + length])
    return [(a, b) for a, b in out]


def _run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows of ``length`` bytes, and with ``words`` of ``WORDS`` words; start and stop in bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()

        def rows(doc: list[int], th: list[int], texts: list[bytes]) -> pa.RecordBatch:
            text, size = b"".join(texts), np.array([len(t) for t in texts])
            ends = np.cumsum(size)
            key, whole, start, n = window_runs(text, ends, roll, length, gram)
            begin, end, h = word_hashes(text, ends, roll)
            wkey, wwhole, first, wn = window_runs(h, np.searchsorted(begin, ends), roll, WORDS, WORD_GRAM)
            start = np.concatenate((start, begin[first]))
            stop = np.concatenate((start[:len(key)] + n + (length - 1), end[first + wn + (WORDS - 2)]))
            k = np.searchsorted(ends, start, "right")
            off = (ends - size)[k]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((key, wkey))), pa.array(np.concatenate((whole, wwhole))), pa.array(np.array(doc)[k]),
                 pa.array(np.array(th)[k]), pa.array(start - off), pa.array(stop - off), pa.array(np.arange(len(start)) >= len(key))],
                names=["gram", "whole", "doc", "th", "start", "stop", "words"])

        for b in batches:
            doc, th, texts, n = [], [], [], 0
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py().encode()
                if n and n + len(text) > CHUNK:
                    yield rows(doc, th, texts)
                    doc, th, texts, n = [], [], [], 0
                doc.append(d)
                th.append(t)
                texts.append(text)
                n += len(text)
            if n:
                yield rows(doc, th, texts)

    return docs.select("doc", "th", "text").mapInArrow(
        run, schema("gram bigint, whole bigint, doc bigint, th bigint, start bigint, stop bigint, words boolean"))


def _contested_strings(docs: DataFrame, asked: DataFrame, length: int, gram: int) -> DataFrame:
    """The strings asked for, cut out of their documents: ``left`` and ``right`` of the gram, or null with window hashes.

    Rows with ``w1, w2`` are single windows of words, of grams that too many
    strings share, or of strings whose windows have no gram in common.
    """
    lists = asked.groupBy("doc", "th").agg(
        F.collect_list(F.struct("gram", "start", "stop", "many", "once", "words")).alias("asked"))
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        names = ["gram", "doc", "th", "start", "stop", "once", "words", "left", "right", "w1", "w2"]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.binary()] * 2 + [pa.int64()] * 2
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return r

        for b in batches:
            for doc, th, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                text = text.as_py().encode()
                for x in wanted.as_py():
                    start, stop, key, words = x["start"], x["stop"], x["gram"], x["words"]
                    part = text[start:stop]
                    at = None
                    if not words and not x["many"]:
                        n = stop - start - length + 1
                        roll.load(part)
                        hit = np.flatnonzero(roll.grams(gram)[n - 1:reach + 1].view(np.int64) == key)
                        at = int(hit[0]) + n - 1 if len(hit) else None
                    if at is not None:
                        rows.append((key, doc, th, start, stop, x["once"], words, part[:at], part[at + gram:], None, None))
                    else:
                        if words:
                            edges = [m.span() for m in _WORD.finditer(part)]
                            told = part.split()
                            spans = [(edges[i][0], edges[i + WORDS - 1][1], b" ".join(told[i:i + WORDS]))
                                     for i in range(len(edges) - WORDS + 1)]
                        else:
                            spans = [(i, i + length, part[i:i + length]) for i in range(stop - start - length + 1)]
                        for a, z, window in spans:
                            h = xxhash.xxh3_128_intdigest(window)
                            rows.append((key, doc, th, start + a, start + z, x["once"], words, None, None,
                                         (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
                    if len(rows) >= 5000:
                        yield flush()
        if rows:
            yield flush()

    return docs.join(lists, ["doc", "th"]).select("doc", "th", "text", "asked").mapInArrow(
        run, schema("gram bigint, doc bigint, th bigint, start bigint, stop bigint, once boolean, words boolean, "
                    "left binary, right binary, w1 bigint, w2 bigint"))


def _others() -> Column:
    """Whether the rows of a group are of several documents."""
    return (F.min("doc") != F.max("doc")) | (F.min("th") != F.max("th"))


def _shared_words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a run of words that others have as a whole, and the strings to be compared for the rest.

    A string in one document only is open until its document is told by
    another string; all strings of its gram are asked for with it.
    """
    shared = staged(rows.groupBy("gram").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi"), _others().alias("others"))
                    .where("others").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "word-grams")
    met = staged(rows.join(shared, "gram"), "word-met")
    kinds = staged(met.where("mixed").groupBy("gram", "whole").agg(
        _others().alias("others"), F.min(F.struct("doc", "th", "start", "stop")).alias("o")), "word-kinds")
    several = kinds.where("others").select("gram", "whole")
    told = staged(met.where("not mixed").select("doc", "th").unionAll(
        met.where("mixed").join(several, ["gram", "whole"], "left_semi").select("doc", "th")).distinct(), "word-told")
    open_grams = kinds.where("not others").select("gram", "o.doc", "o.th").join(told, ["doc", "th"], "left_anti").select("gram").distinct()
    asked = kinds.join(open_grams, "gram", "left_semi").select(
        "gram", "o.*", (~F.col("others")).alias("once"), F.lit(True).alias("many"), F.lit(True).alias("words"))
    return told, asked


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, th, words, a, b``: byte spans (they may overlap) covered by strings of ``length`` bytes that start twice.

    Rows with ``words`` only tell that the document has ``WORDS`` words in a row that another one has too.
    """
    runs = staged(_run_rows(docs, length, gram), "runs")
    rows = runs.where("not words").drop("words")
    shared = staged(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
                    .where("c > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    met = staged(rows.join(shared, "gram"), "met")
    mixed = met.where("mixed")
    kinds = staged(mixed.groupBy("gram", "whole").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "th", "start", "stop")).alias("o")), "kinds")
    # strings that occur twice: every window in them is repeated
    twice = kinds.where("c > 1").select("gram", "whole")
    sure = met.where("not mixed").select("doc", "th", "start", "stop").unionAll(
        mixed.join(twice, ["gram", "whole"], "left_semi").select("doc", "th", "start", "stop")).select(
        "doc", "th", F.lit(False).alias("words"), F.col("start").alias("a"), F.col("stop").alias("b"))
    # one of each string of a gram that has several; those that occur once are to be decided
    strings = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("strings"))
    told, open_words = _shared_words(runs.where("words").drop("words"))
    asked = kinds.join(strings, "gram").select(
        "gram", "o.*", (F.col("c") == 1).alias("once"), (F.col("strings") > MANY).alias("many"), F.lit(False).alias("words")).unionAll(open_words)
    cut = staged(_contested_strings(docs, asked, length, gram), "contested")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> pa.RecordBatch:
            strings = list(dict.fromkeys((g[5], g[6]) for g in group))
            hits = dict(zip(strings, repeated_windows(strings, length - gram), strict=True))
            doc, th, a, b = [], [], [], []
            for _, d, t, start, once, left, right in group:
                if once:
                    for x, y in _spans(hits[left, right], length):
                        doc.append(d)
                        th.append(t)
                        a.append(start + x)
                        b.append(start + y)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, th, a, b)], names=["doc", "th", "a", "b"])

        now, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if len(group) > 1:
                        yield settle(group)
                    now, group = row[0], []
                group.append(row)
        if len(group) > 1:
            yield settle(group)

    # few bytes but much work: a fixed number of tasks, which adaptive execution does not merge
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (cut.where("w1 is null").select("gram", "doc", "th", "start", "once", "left", "right")
               .repartition(tasks, "gram").sortWithinPartitions("gram").mapInArrow(decide, schema("doc bigint, th bigint, a bigint, b bigint"))
               .select("doc", "th", F.lit(False).alias("words"), "a", "b"))
    single = cut.where("w1 is not null")
    window = ["words", "w1", "w2"]
    again = single.groupBy(window).agg(F.count(F.lit(1)).alias("c"), F.bool_or(~F.col("once")).alias("more"), _others().alias("others")).where(
        F.when(F.col("words"), F.col("more") | F.col("others")).otherwise(F.col("c") > 1)).select(window)
    late = single.where("once").join(again, window, "left_semi").select(
        "doc", "th", "words", F.col("start").alias("a"), F.col("stop").alias("b"))
    return sure.unionAll(ordered).unionAll(late).unionAll(
        told.select("doc", "th", F.lit(True).alias("words"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the maximal runs that the spans cover."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *(x for r in runs for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), [(a, b) for a, b in runs]


def suffix_dedup_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage``.

    Every byte covered by a string of ``length`` bytes that also starts
    anywhere else goes. Texts are UTF-8 bytes; null counts as empty; a
    shorter text is kept whole. Repeated rows are two documents, so both go;
    a null id is kept as null; an empty table gives no rows; other columns
    are not read. Strings that are equal as a whole are recognised by 64-bit
    hashes under their gram's 64-bit hash.

    ``shares_passage`` is 1 if ``WORDS`` words ``[^\\x20\\x09-\\x0D]+`` in a row are
    in another document too, word for word, whatever their length in bytes and
    the white space between them, else 0. A row of the same id and text is not
    another document there.
    """
    rows = id_and_text(docs).select(known_id().alias("doc"), F.xxhash64("text").alias("th"), "text")
    spans = repeated_spans(rows, length, gram).groupBy("doc", "th").agg(
        F.collect_set(F.when(~F.col("words"), F.struct("a", "b"))).alias("spans"), F.max("words").cast("int").alias("shares"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, sha = [], [], [], []
            for text, got in zip(b.column(1), b.column(2), strict=True):
                text = text.as_py().encode()
                kept, cut = cut_spans(text, [(x["a"], x["b"]) for x in got.as_py() or ()])
                size.append(len(text))
                gone.append(len(text) - len(kept))
                runs.append(len(cut))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, runs)), pa.array(sha, pa.string()),
                 b.column(3)],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])

    return rows.join(spans, ["doc", "th"], "left").select("doc", "text", "spans", F.coalesce("shares", F.lit(0))).mapInArrow(
        run, schema("doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, shares_passage int")).select(
        real_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")
