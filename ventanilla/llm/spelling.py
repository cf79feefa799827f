"""Operator 11, spelling variant grouping: a trie-node pair dictionary.

Every word is a path in a forward trie and, read backwards, a path in a
reversed trie; the nodes of both are numbered. A word with position i skipped
is the pair (node of the prefix before i, node of the suffix after i), a word
split before i is the pair (node of the prefix, node of the suffix). Equal
pairs are exactly the words one edit apart: two skips differ by a replaced
code point, a skip and a split by an inserted or deleted one. All rows are
integers; a pair holds at most one split and one skip per code point of the
alphabet (90), so a group is small by its making, and its best two rows and
counts give every member's neighbours without listing pairs.

Nodes are numbered in sorted order: a word owns a range of numbers as long as
itself and opens the nodes below what it shares with the word before it. A
sorted range partition is read with one running path; what its first word
shares with the last word of the partition before comes from the ends of all
partitions, one row each, so memory is bounded by a word's length per
partition, not by the dictionary.

Defined cases: null texts hold no runs; a null id counts as the empty text in
``<doc_id>:<run>``; repeated rows count again; an empty table gives no rows;
other columns are left out. A run of any length is one word. Words of equal
count are ranked by code points.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import id_and_text, staged

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF; one byte each in Latin-1.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A run is misspelt where this number divides its checksum.
SLIP_EVERY = 199
#: A form is at least so many times as common as the word.
TIMES = 5
#: Words that a task counts before it hands its counts on; a size of buffer, no cap.
BUFFER = 400_000
#: Node numbers that a task puts out at once.
CHUNK = 1 << 20

_FOLD = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def run_counts(text: str) -> Counter:
    """The lower-cased runs of a whole text (as Latin-1 bytes) with their counts."""
    return Counter(text.encode("latin-1", "replace").translate(_FOLD).split())


def slipped(run: bytes, seed: int, every: int) -> bytes:
    """The run, or the run without the code point that its checksum picks."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def _count_words(least: int, every: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w, k in run_counts(text.as_py()).items():
                    if len(w) >= least:
                        w = slipped(w, seed, every)
                        counts[w] = counts.get(w, 0) + k
                if len(counts) > BUFFER:
                    yield out()
                    counts.clear()
        if counts:
            yield out()
    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                slip_every: int = SLIP_EVERY) -> DataFrame:
    """``word, n``: every word of the whole table that is long and common enough."""
    counted = id_and_text(docs).mapInArrow(_count_words(least_length, slip_every), "word string, n bigint")
    return (counted.groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.length("word") >= least_length) & (F.col("n") >= least_count)))


# --- trie nodes ----------------------------------------------------------------

def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def follow(path: list[int], last: str, word: str, base: int) -> None:
    """Turn the path of ``last`` into that of ``word``: shared nodes stay, new ones get base + depth."""
    d = shared(last, word)
    del path[d:]
    path.extend(range(base + d + 1, base + len(word) + 1))


class _Walk:
    """The running path through the sorted words of one range partition after another."""

    def __init__(self, inherited: dict[int, list[int]]):
        self.inherited, self.part = inherited, None

    def step(self, part: int, word: str) -> list[int]:
        if part != self.part:
            self.part, self.base, self.first = part, (part << 40), word
            self.path = list(range(self.base + 1, self.base + len(word) + 1))
            known = self.inherited.get(part, [])
            self.path[:len(known)] = known
        else:
            follow(self.path, self.last, word, self.base)
        self.base += len(word)
        self.last = word
        return self.path


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walk, rows = _Walk({}), []

    def end():
        return walk.part, walk.first, walk.last, list(walk.path)

    for b in batches:
        for part, word in zip(b["part"], b["word"]):
            if walk.part is not None and part != walk.part:
                rows.append(end())
            walk.step(part, word)
    if walk.part is not None:
        rows.append(end())
    yield pd.DataFrame(rows, columns=["part", "first", "last", "path"])


def _paths(inherited: dict[int, list[int]]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, nos, paths, size = _Walk(inherited), [], [], 0
        for b in batches:
            for no, part, word in zip(b["no"], b["part"], b["word"]):
                nos.append(no)
                paths.append(np.array(walk.step(part, word), "i8"))
                size += len(word)
                if size > CHUNK:
                    yield pd.DataFrame({"no": nos, "path": paths})
                    nos, paths, size = [], [], 0
        if nos:
            yield pd.DataFrame({"no": nos, "path": paths})
    return run


def inherited_paths(ends: list[tuple[int, str, str, list[int]]]) -> dict[int, list[int]]:
    """Per partition the nodes that its first word shares with the last word of the partition before."""
    out: dict[int, list[int]] = {}
    before: tuple[str, list[int]] | None = None
    for part, first, last, path in sorted(ends):
        if before:
            known = before[1][:shared(before[0], first)]
            out[part] = known
            depth = min(shared(first, last), len(known))
            path = known[:depth] + path[depth:]
        before = (last, path)
    return out


def trie_paths(words: DataFrame) -> DataFrame:
    """``no, path``: the trie nodes of every prefix (from one code point on) of ``word``.

    ``words`` holds ``no, word, at`` with ``at`` from a range-partitioned sort
    by ``word`` (partition in the high bits), see ``ranked``.
    """
    dealt = (words.select("no", "word", "at", F.shiftright("at", 33).cast("int").alias("part"))
             .repartition("part").sortWithinPartitions("part", "at"))
    ends = [tuple(r) for r in dealt.mapInPandas(_ends, "part int, first string, last string, path array<bigint>").collect()]
    return dealt.mapInPandas(_paths(inherited_paths(ends)), "no bigint, path array<bigint>")


def ranked(words: DataFrame, name: str) -> DataFrame:
    """The rows sorted by ``word`` over range partitions, ``at`` rising with it; written once."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(words.repartitionByRange(n, "word").sortWithinPartitions("word")
                  .withColumn("at", F.monotonically_increasing_id()), name)


# --- pairs of nodes --------------------------------------------------------------

SPLIT, SKIP, SKIP_FIRST = 0, 1, 2


def node_pairs(word: str, prefixes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of one word: prefix node, suffix node and kind, its splits before its skips.

    Only the first of a row of equal code points is a skip that a split may
    meet: skipping any other of them gives the same shorter word again.
    """
    p = np.concatenate(([0], prefixes)).astype("i8")
    s = np.concatenate(([0], suffixes)).astype("i8")[::-1]
    new = np.ones(len(word), "i1")
    cp = np.frombuffer(word.encode("utf-32-le"), "<u4")
    new[1:] = cp[1:] != cp[:-1]
    return np.concatenate((p, p[:-1])), np.concatenate((s, s[1:])), np.concatenate((np.zeros(len(p), "i1"), SKIP + new))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["p", "s", "kind", "no", "n"]

    def out(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)

    for b in batches:
        parts, size = [], 0
        for no, n, word, fwd, rev in zip(b["no"].to_pylist(), b["n"].to_pylist(), b["word"].to_pylist(), b["fwd"], b["rev"]):
            p, s, kind = node_pairs(word, fwd.values.to_numpy(), rev.values.to_numpy())
            parts.append((p, s, kind, np.full(len(p), no), np.full(len(p), n)))
            size += len(p)
            if size > CHUNK:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)


def near_of_groups(p, s, kind, no, n):
    """Rows sorted by pair, falling ``n``, rising ``no``: per member ``no, near, best_n, best_no`` in its group."""
    cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))
    size = np.diff(np.concatenate((cut, [len(p)])))
    keep = np.repeat(size > 1, size)
    kind, no, n, size = kind[keep], no[keep], n[keep], size[size > 1]
    if not len(size):
        return no, no, no, no
    cut = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    at, none = np.arange(len(no)), len(no)

    def first(mask):
        return np.minimum.reduceat(np.where(mask, at, none), cut)

    skip, new, split = kind != SPLIT, kind == SKIP_FIRST, kind == SPLIT
    skips, news, splits = (np.add.reduceat(m.astype("i8"), cut)[group] for m in (skip, new, split))
    any1 = first(np.ones(len(no), bool))
    any2 = any1 + 1
    skip1 = first(skip)
    skip2 = first(skip & (at != skip1[group]))
    new1 = first(new)
    other_any = np.where(at == any1[group], any2[group], any1[group])
    other_skip = np.where(at == skip1[group], skip2[group], skip1[group])
    best = np.where(split, new1[group], np.where(new, other_any, other_skip))
    near = np.where(split, news, skips - 1 + np.where(new, splits, 0))
    has = near > 0
    best = best[has]
    return no[has], near[has], n[best], no[best]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["no", "near", "best_n", "best_no"]
    rest = None
    for b in batches:
        cols = [b[c].to_numpy() for c in ("p", "s", "kind", "no", "n")]
        if not len(cols[0]):
            continue
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        p, s = cols[:2]
        last = np.flatnonzero((p != p[-1]) | (s != s[-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last pair may go on in the next batch
        rest = [c[cut:] for c in cols]
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in near_of_groups(*(c[:cut] for c in cols))], names)
    if rest is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in near_of_groups(*rest)], names)


def neighbours(words: DataFrame) -> DataFrame:
    """``no, n_near, best_n, best_no`` of every word that has a near one; ``words`` from ``ranked``."""
    fwd = trie_paths(words.select(F.col("at").alias("no"), "word", "at"))
    back = ranked(words.select(F.reverse("word").alias("word"), F.col("at").alias("no")), "spelling-back")
    both = (words.select(F.col("at").alias("no"), "word", "n")
            .join(fwd.select("no", F.col("path").alias("fwd")), "no")
            .join(trie_paths(back).select("no", F.col("path").alias("rev")), "no"))
    pairs = both.mapInArrow(_pairs, "p bigint, s bigint, kind tinyint, no bigint, n bigint")
    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.col("n").desc(), "no")
    near = dealt.mapInArrow(_near, "no bigint, near bigint, best_n bigint, best_no bigint")
    return (near.groupBy("no").agg(F.sum("near").alias("n_near"),
                                   F.max(F.struct("best_n", (-F.col("best_no")).alias("neg"))).alias("_b"))
            .select("no", "n_near", "_b.best_n", (-F.col("_b.neg")).alias("best_no")))


def roots(forms: DataFrame) -> DataFrame:
    """``no, root``: the end of each word's chain of forms, by doubling.

    A form is ``TIMES`` times as common as its word, so chains are short and
    acyclic; the rounds end when no target has a form of its own.
    """
    cur = forms.select("no", F.col("form_no").alias("to"))
    while True:
        nxt = cur.select(F.col("no").alias("_no"), F.col("to").alias("_to"))
        cur = staged(cur.join(nxt, F.col("to") == F.col("_no"), "left")
                     .select("no", F.coalesce("_to", "to").alias("to"), F.col("_no").isNotNull().alias("moved")), "spelling-root")
        if cur.where("moved").isEmpty():
            return cur.select("no", F.col("to").alias("root_no"))
        cur = cur.drop("moved")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Forms and roots of the words of ``words(word, n)``: ``word, form, root, n, n_near, form_n``."""
    if times <= 1:
        raise ValueError("a form must be commoner than its word")
    words = ranked(words, "spelling-words")
    near = staged(neighbours(words), "spelling-near")
    all_ = words.select(F.col("at").alias("no"), "word", "n").join(near, "no", "left")
    has_form = F.col("best_n") >= times * F.col("n")
    named = staged(all_.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                               F.when(has_form, F.col("best_no")).alias("form_no"),
                               F.when(has_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    chains = roots(named.where("form_no is not null"))
    spelt = named.select(F.col("no").alias("_no"), F.col("word").alias("_word"))
    targets = (named.where("form_no is not null").join(chains, "no")
               .join(spelt.toDF("form_no", "form"), "form_no").join(spelt.toDF("root_no", "root"), "root_no")
               .select("no", "form", "root"))
    return (named.join(targets, "no", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_report(docs: DataFrame) -> DataFrame:
    """Every word of the whole table with its form, root, counts and number of near words."""
    return group_variants(staged(word_counts(docs), "spelling-counts"))


#: The same rows in DuckDB SQL; the checksum is built up from its polynomial.
SPELLING_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
runs AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM found WHERE length(raw) >= 6 GROUP BY ALL),
sums AS (
  SELECT run, k, xor(4294967295, list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
        lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                        ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] END))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM runs, tab),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word,
         sum(k)::BIGINT AS n
  FROM sums GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
skips AS (
  SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
links AS (
  SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON b.word = concat(a.p, a.s)
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON b.word = concat(a.p, a.s)),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM links GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 5 * w.n THEN (SELECT min(l.other) FROM links l WHERE l.word = w.word AND l.m = b.m) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
