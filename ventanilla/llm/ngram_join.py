"""N-gram Jaccard join by vertical partitioning.

Every document's set of word n-grams is cut along one global hash order into
vertical fragments, so neither a long document nor a frequent n-gram decides
how large a task is. A fragment finds which of its n-grams several distinct
sets hold; the partial counts, summed per set, leave only the sets that can
reach the threshold. Candidate pairs of those are counted fragment by
fragment and the partial overlaps are summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventanilla.llm.common import NULL_ID, connected, id_and_text, known_id, real_id, schema, staged

#: Words in an n-gram, least Jaccard similarity in percent.
WORDS, PERCENT = 5, 75
#: Documents looked at to find very frequent n-grams and the mean set size, and the
#: copies in that sample from which an n-gram counts as frequent. They steer the order only.
SAMPLE_DOCS, FREQUENT = 20_000, 20
#: n-grams a fragment should hold; n-grams a task gathers before it deals them out.
PER_FRAGMENT, CHUNK = 1_000_000, 400_000
#: Ranges of sets that a fragment's rows are packed for at once; more are split off in further passes.
FAN = 64
#: Frequency classes of the global order (the last: frequent in the sample); hash ranges of a class.
CLASSES, RANGES = 24, 2
#: Members of a bucket that the others are compared with, round by round, before the rest is compared in full.
PIVOTS = (1, 12)
#: Sets in a block of that full comparison; hash fragments whose sizes bound an overlap there.
BLOCK, FRAGMENTS = 2000, 128

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per distinct word of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(text: str, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one n-gram."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at space and 9 to 13
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    v = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        v = v * _MUL + h[i:i + len(v)]
    v ^= v >> np.uint64(32)
    v *= _MIX
    v ^= v >> np.uint64(29)
    v.sort()
    return v[np.concatenate(([True], v[1:] != v[:-1]))]


def signature(grams: np.ndarray) -> int | None:
    """Identifies a set of n-grams; an empty one has none."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def _sample(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Hashes of n-grams frequent in a bounded sample of documents, and the n-grams expected in all."""
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sets = [ngram_set(t.as_py(), cache, n) for t in b.column(0)] or [np.empty(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    some = docs.select("text").sample(fraction=share, seed=7) if share < 1 else docs.select("text")
    counts = staged(some.mapInArrow(run, schema("h bigint")).groupBy("h").count(), "ngram-sample")
    size = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("count") >= FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(often.view(np.uint64)), int(size / share)


def _deal(docs: DataFrame, n: int, often: np.ndarray, fragments: int) -> DataFrame:
    """Rows of two kinds, keyed by ``part``: fragments with packed (set, n-grams), and document rows.

    ``sig`` identifies a set. Frequent n-grams are listed in the document row
    (as indices) and not dealt out: several sets hold them anyway.
    """
    known = docs.sparkSession.sparkContext.broadcast(often)  # at most SAMPLE_DOCS sets / FREQUENT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, often = WordHashes(), known.value
        names = ["part", "doc", "sig", "n", "often", "body"]

        def rows(part, doc, sig, size, listed, body) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(sig, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(listed, pa.binary()), pa.array(body, pa.binary())], names=names)

        def dealt(sigs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            if not len(h):
                return None
            own = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
            frag = ((h >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            h, own, frag = h[order], own[order], frag[order]
            sig = np.asarray(sigs, np.int64)
            cut = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1]))).tolist() + [len(h)]
            part, body = [], []
            for a, b in zip(cut, cut[1:]):
                first = np.flatnonzero(np.concatenate(([True], own[a + 1:b] != own[a:b - 1])))
                counts = np.diff(np.append(first, b - a)).astype("<i4")
                part.append(int(frag[a]))
                body.append(np.int32(len(first)).tobytes() + sig[own[a + first]].tobytes() + counts.tobytes()
                            + (h[a:b] >> np.uint64(1)).astype("<i8").tobytes())
            none = [None] * len(part)
            return rows(part, none, none, none, none, body)

        for b in batches:
            doc, sig, size, listed = [], [], [], []
            wait_sig, wait_set, held = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = ngram_set(t.as_py(), cache, n)
                doc.append(d)
                size.append(len(s))
                g = signature(s)
                sig.append(g)
                if g is None:
                    listed.append(None)
                    continue
                at = np.searchsorted(often, s)
                hit = often[np.minimum(at, len(often) - 1)] == s if len(often) else np.zeros(len(s), bool)
                listed.append(at[hit].astype("<u4").tobytes())
                wait_sig.append(g)
                wait_set.append(s[~hit])
                held += len(s)
                if held >= CHUNK:
                    got = dealt(wait_sig, wait_set)
                    if got:
                        yield got
                    wait_sig, wait_set, held = [], [], 0
            got = dealt(wait_sig, wait_set)
            if got:
                yield got
            # by set and id: neither copies of one text nor empty ones gather in one part
            yield rows([fragments + ((g or 0) + d * 0x9E3779B97F4A7C15 >> 20) % fragments for g, d in zip(sig, doc, strict=True)], doc, sig, size, listed, [None] * len(doc))

    return docs.select("doc", "text").mapInArrow(
        run, schema("part int, doc bigint, sig bigint, n bigint, often binary, body binary"))


def set_ranges(sig: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each set: equal parts of the signatures' 32 upper bits."""
    return ((sig.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def packed(sig: np.ndarray, toks: np.ndarray, rank: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """``(range, body)`` of entries ``(set, n-gram, class)``: one body holds all sets of a range."""
    cell = set_ranges(sig, ranges)
    order = np.lexsort((toks, sig, cell))
    sig, toks, rank, cell = sig[order], toks[order], rank[order], cell[order]
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))).tolist() + [len(cell)]
    for a, b in zip(cut, cut[1:]):
        first = np.flatnonzero(np.concatenate(([True], sig[a + 1:b] != sig[a:b - 1])))
        counts = np.diff(np.append(first, b - a)).astype("<i4")
        yield int(cell[a]), (np.int32(len(first)).tobytes() + sig[a + first].tobytes() + counts.tobytes()
                             + toks[a:b].tobytes() + rank[a:b].tobytes())


def unpacked(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ``(set, n-gram, class)`` of packed bodies."""
    out = []
    for body in bodies:
        k = int(np.frombuffer(body, "<i4", 1)[0])
        counts = np.frombuffer(body, "<i4", k, 4 + 8 * k)
        m, at = int(counts.sum()), 4 + 12 * k
        out.append((np.repeat(np.frombuffer(body, "<i8", k, 4), counts), np.frombuffer(body, "<i8", m, at),
                    np.frombuffer(body, "u1", m, at + 8 * m)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _cells(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["cell", "body"])


def _by_cell(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[list[bytes]]:
    """The bodies of one cell after another, from rows sorted by cell; in lists of about ``most`` bytes if given."""
    cell, bodies, size = None, [], 0
    for b in batches:
        for c, body in zip(b.column(0).to_pylist(), b.column(1)):
            if bodies and (c != cell or most and size > most):
                yield bodies
                bodies, size = [], 0
            cell = c
            bodies.append(body.as_py())
            size += len(bodies[-1])
    if bodies:
        yield bodies


def _shares_of_sets(parts: DataFrame, ranges: int) -> DataFrame:
    """``sig, live, toks, ranks`` per set: the n-grams that it shares, from the fragments' packed rows.

    A range of sets is gathered in one task; it holds about as many n-grams as
    a fragment. Where there are more than ``FAN`` ranges, the rows are split to
    finer ranges in passes that hold a few bodies at a time.
    """
    now = min(ranges, FAN)
    while now < ranges:
        finer = min(ranges, now * FAN)

        def split(batches: Iterator[pa.RecordBatch], finer: int = finer) -> Iterator[pa.RecordBatch]:
            for bodies in _by_cell(batches, most=9 * CHUNK):
                yield _cells(list(packed(*unpacked(bodies), finer)))

        salt = F.pmod(F.xxhash64("body"), F.lit(FAN))
        parts = staged(parts.repartition("cell", salt).sortWithinPartitions("cell").mapInArrow(split, schema("cell int, body binary")), "ngram-cells")
        now = finer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bodies in _by_cell(batches):
            sig, toks, rank = unpacked(bodies)
            order = np.argsort(sig, kind="stable")
            sig, toks, rank = sig[order], toks[order], rank[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            cut = np.append(first, len(sig))
            toks, rank = toks.tobytes(), rank.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[first]), pa.array(np.diff(cut)), pa.array([toks[8 * a:8 * b] for a, b in zip(cut, cut[1:])], pa.binary()),
                 pa.array([rank[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], names=["sig", "live", "toks", "ranks"])

    return parts.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema("sig bigint, live bigint, toks binary, ranks binary"))


def _count_fragments(dealt: DataFrame, ranges: int) -> DataFrame:
    """Per fragment and range of sets: their n-grams that other sets hold too, packed in one row (``cell``, ``body``).

    Document rows pass through. N-grams are the upper 63 bits of the hashes;
    the class of each is ``floor(log2(number of sets))``.
    """

    def shared(bodies: list[bytes]) -> pa.RecordBatch | None:
        hs, ss = [], []
        for body in bodies:
            k = int(np.frombuffer(body, "<i4", 1)[0])
            sig = np.frombuffer(body, "<i8", k, 4)
            counts = np.frombuffer(body, "<i4", k, 4 + 8 * k)
            m, at = int(counts.sum()), 4 + 12 * k
            hs.append(np.frombuffer(body, "<i8", m, at))
            ss.append(np.repeat(sig, counts))
        h, s = np.concatenate(hs), np.concatenate(ss)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        keep = np.append(same, False) | np.concatenate(([False], same))
        h, s = h[keep], s[order][keep]
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        keep = np.ones(len(h), bool)  # copies of one set count once
        keep[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[keep], s[keep]
        if not len(h):
            return None
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        held = np.diff(np.append(first, len(h)))
        held = np.repeat(held, held)
        h, s, held = h[held > 1], s[held > 1], held[held > 1]
        if not len(h):
            return None
        rank = np.minimum(np.log2(held), CLASSES - 2).astype("u1")
        rows = list(packed(s, h, rank, min(ranges, FAN)))
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), *_cells(rows).columns],
            names=["doc", "sig", "n", "often", "cell", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bodies = None, []
        for b in batches:
            t = pa.Table.from_batches([b])
            info = t.filter(t["body"].is_null()).select(["doc", "sig", "n", "often"])
            for r in info.append_column("cell", pa.nulls(len(info), pa.int32())).append_column(
                    "body", pa.nulls(len(info), pa.binary())).to_batches():
                yield r
            t = t.filter(t["body"].is_valid())
            for p, body in zip(t["part"].to_pylist(), t["body"].to_pylist(), strict=True):
                if p != part:
                    got = shared(bodies) if bodies else None
                    if got:
                        yield got
                    part, bodies = p, []
                bodies.append(body)
        got = shared(bodies) if bodies else None
        if got:
            yield got

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(
        run, schema("doc bigint, sig bigint, n bigint, often binary, cell int, body binary"))


def _fragments_of_sets(rows: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Per remaining set: one row per fragment of the global order, and one (``v`` null) for the set.

    The latter has all its n-grams in order, ``prefix`` of which are its
    prefix, ``sizes``, the n-grams of each frequency class, and ``parts``,
    the n-grams of each of ``FRAGMENTS`` hash fragments.

    The order is by frequency class, then hash; n-grams only this set holds
    come first and frequent ones last. A set that reaches the threshold with
    another shares one of its first ``n - ceil(n * percent / 100) + 1``.
    """

    def one(sig: int, n: int, often: bytes, toks: bytes | None, ranks: bytes | None) -> tuple[list, ...]:
        toks, rank = np.frombuffer(toks or b"", "<i8"), np.frombuffer(ranks or b"", "u1")
        listed = np.frombuffer(often, "<u4").astype(np.int64)
        toks = np.concatenate((toks, -1 - listed))
        rank = np.concatenate((rank, np.full(len(listed), CLASSES - 1, "u1"))).astype(np.int64)
        order = np.lexsort((toks, rank))
        toks, rank = toks[order], rank[order]
        prefix = n - -(-n * percent // 100) + 1 - (n - len(toks))
        v = rank * RANGES + np.where(toks < 0, 0, ((toks >> 39) * fragments >> 24) * RANGES // fragments)
        vs, lists, sizes, heads = [None], [toks], [np.bincount(rank, minlength=CLASSES).tolist()], [prefix]
        part = (toks.view(np.uint64) * _MIX >> np.uint64(32)).astype(np.int64) % FRAGMENTS
        parts = [np.bincount(part, minlength=FRAGMENTS).astype("<u4").tobytes()]
        cut = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))).tolist() + [len(v)]
        for a, b in zip(cut, cut[1:]):
            vs.append(int(v[a]))
            lists.append(toks[a:b])
            sizes.append(None)
            heads.append(None)
            parts.append(None)
        return [sig] * len(vs), [n] * len(vs), vs, lists, sizes, heads, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]

        def flush() -> pa.RecordBatch:
            lists = [x.tolist() for x in out[3]]
            r = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32())),
                 pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())],
                names=["sig", "n", "v", "toks", "sizes", "prefix", "parts"])
            for c in out:
                c.clear()
            return r

        for b in batches:
            for row in zip(*b.columns, strict=True):
                for col, x in zip(out, one(*(v.as_py() for v in row)), strict=True):
                    col += x
                if len(out[0]) > 2000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, schema(
        "sig bigint, n bigint, v int, toks array<bigint>, sizes array<int>, prefix int, parts binary"))


def _linked(pairs: DataFrame, frags: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, an, b, bn)`` those that reach the threshold: overlaps per fragment, summed per pair."""
    left = frags.select(F.col("sig").alias("a"), "v", F.col("toks").alias("at"))
    right = frags.select(F.col("sig").alias("b"), "v", F.col("toks").alias("bt"))
    part = pairs.join(left, "a").join(right, ["b", "v"]).select(
        "a", "an", "b", "bn", F.size(F.array_intersect("at", "bt")).cast("bigint").alias("o"))
    return (part.groupBy("a", "an", "b", "bn").agg(F.sum("o").alias("o"))
            .where(F.col("o") * 100 >= percent * (F.col("an") + F.col("bn") - F.col("o"))).select("a", "b"))


def hopeful_pairs(one: tuple, two: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks ``(mark, n, parts)`` with different marks whose fragment sizes allow the threshold.

    An overlap is at most the sum over the fragments of the smaller size.
    """
    (m1, n1, p1), (m2, n2, p2) = one, two
    left, right = [], []
    for i in range(len(m1)):
        j = np.flatnonzero((m2 != m1[i]) & (np.minimum(n2, n1[i]) * 100 >= np.maximum(n2, n1[i]) * percent))
        if len(j):
            most = np.minimum(p2[j], p1[i]).sum(axis=1, dtype=np.int64)
            j = j[most * 100 >= percent * (n1[i] + n2[j] - most)]
            left.append(np.full(len(j), i))
            right.append(j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)


def _full(left: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, an, b, bn)`` of a bucket with different marks, compared block against block by fragment sizes.

    Of two different marks one is not the commonest of the bucket's first
    block, so only sets with another mark are held against all.
    """
    cuts = left.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    rows = left.select("tok", "sig", "mark").join(heads.select("sig", "n", "parts"), "sig").join(cuts, "tok").withColumn(
        "own", F.pmod(F.xxhash64("sig"), F.col("cuts")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "mark", "n", "parts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(group: list[tuple]) -> pa.RecordBatch:
            own = np.array([g[3] for g in group])
            sig, mark, n = (np.array([g[k] for g in group], np.int64) for k in (4, 5, 6))
            parts = np.frombuffer(b"".join(g[7] for g in group), "<u4").reshape(len(group), FRAGMENTS)
            marks, times = np.unique(mark, return_counts=True)
            odd = np.flatnonzero(mark != marks[times.argmax()])
            out = [[], [], [], []]
            for x, y in {(group[0][1], group[0][2]), (group[0][2], group[0][1])}:
                one, two = odd[own[odd] == x], np.flatnonzero(own == y)
                a, b = hopeful_pairs((mark[one], n[one], parts[one]), (mark[two], n[two], parts[two]), percent)
                a, b = one[a], two[b]
                a, b = np.where(sig[a] < sig[b], a, b), np.where(sig[a] < sig[b], b, a)
                for col, v in zip(out, (sig[a], n[a], sig[b], n[b]), strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["a", "an", "b", "bn"])

        now, group = None, []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if row[:3] != now:
                    if group:
                        yield settle(group)
                    now, group = row[:3], []
                group.append(row)
        if group:
            yield settle(group)

    keys = ["tok", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        compare, schema("a bigint, an bigint, b bigint, bn bigint")).distinct()


def _links(frags: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between sets whose components are those of all links.

    Sets that share a prefix n-gram form a bucket. A round compares a few
    members of each bucket with the others, so a large group of near copies
    costs some comparisons per member, not one per pair. A pair is left out
    when links so far connect the two (they carry the same mark), or when the
    sizes of their frequency classes rule the threshold out. After the rounds
    of ``PIVOTS`` all pairs that are left are compared, in blocks by their
    fragment sizes and then exactly.
    """
    spark = frags.sparkSession
    cuts = frags.where("v is not null").select("sig", "v", "toks")
    heads = frags.where("v is null")
    bucket = heads.select("sig", F.explode(F.slice("toks", F.lit(1), F.col("prefix"))).alias("tok"))
    nodes = heads.select("sig", "n", "sizes", F.col("sig").alias("mark"))
    links = spark.createDataFrame([], schema("a bigint, b bigint"))
    most = F.expr("aggregate(zip_with(asizes, bsizes, (x, y) -> least(x, y)), 0L, (t, x) -> t + x)")
    compared = 1  # buckets of so many members need no more
    for k, pivots in enumerate((*PIVOTS, None)):
        cur = bucket.join(nodes.select("sig", "mark"), "sig")
        mixed = cur.groupBy("tok").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count(F.lit(1)).alias("members"))
        mixed = mixed.where("lo <> hi").where(F.col("members") > compared).select("tok", "members")
        left = staged(cur.join(mixed, "tok"), "buckets")
        if left.isEmpty():
            break
        if pivots is None:
            links = links.unionAll(staged(_linked(_full(left, heads, percent), cuts, percent), "links"))
            break
        # of a bucket with no more members all are taken, so all its pairs are compared
        slot = F.when(F.col("members") > pivots, F.pmod(F.xxhash64("sig", F.lit(k)), F.lit(pivots))).otherwise(F.col("sig"))
        few = left.groupBy("tok", slot.alias("slot")).agg(F.min("sig").alias("a"))
        compared = pivots
        pairs = left.join(few, "tok").where("sig <> a").select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b"))
        ends = [nodes.select(F.col("sig").alias(e), F.col("n").alias(f"{e}n"), F.col("sizes").alias(f"{e}sizes"),
                             F.col("mark").alias(f"{e}mark")) for e in "ab"]
        hopeful = (pairs.distinct().join(ends[0], "a").join(ends[1], "b").where("amark <> bmark")
                   .where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
                   .where(most * 100 >= percent * (F.col("an") + F.col("bn") - most)))
        new = staged(_linked(hopeful.select("a", "an", "b", "bn"), cuts, percent), "links")
        links = links.unionAll(new)
        bucket = left.select("sig", "tok")
        roots = connected(links) if k else new.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        nodes = staged(nodes.join(roots, nodes["sig"] == roots["node"], "left").select(
            "sig", "n", "sizes", F.coalesce("root", "sig").alias("mark")), "nodes")
    return links


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of
    their n-gram sets; ``component_id`` is the smallest id reachable by
    links. Null, empty and blank texts have no set and link with nothing
    (their component is their own id). Rows with equal sets, repeated rows
    included, are one class; a null id is never the smallest unless a
    component has no other, and then its component is null. An empty table
    gives no rows; other columns are not read. N-grams are told
    apart by 63 bits of their hashes.
    """
    info, named = _classes(id_and_text(docs, id_col, text_col).select(known_id().alias("doc"), "text"), words, percent)
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    groups = named.join(lows, "root").select("sig", "component")
    return info.join(groups, "sig", "left").select(
        real_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), real_id("doc")).otherwise(F.col("component")).alias("component_id"))


def _classes(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows ``doc, text``: ``doc, sig, n`` per row, and ``sig, low, root`` per set.

    ``low`` is the smallest id of the set's rows, null if they have none;
    ``root`` names its component.
    """
    often, expected = _sample(rows, words)
    fragments = max(8, -(-expected // PER_FRAGMENT))
    told = staged(_count_fragments(_deal(rows, words, often, fragments), fragments), "ngrams")
    info, parts = told.where("body is null"), told.where("body is not null").select("cell", "body")
    sets = staged(info.where("sig is not null").groupBy("sig").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("doc") != F.lit(-(2 ** 63)).cast("bigint"), F.col("doc"))).alias("low"),
        F.first("often").alias("often")), "sets")
    # every n-gram a set shares with any other set, summed over the fragments
    shares = _shares_of_sets(parts, fragments)
    able = sets.join(shares, "sig", "left").where(
        (F.coalesce("live", F.lit(0)) + F.length("often") / 4) * 100 >= F.col("n") * percent)
    frags = staged(_fragments_of_sets(able.select("sig", "n", "often", "toks", "ranks"), percent, fragments), "fragments")
    roots = connected(_links(frags, percent))
    named = sets.join(roots, sets["sig"] == roots["node"], "left").select("sig", "low", F.coalesce("root", "sig").alias("root"))
    return info, named


def _signed(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``__sig``, the signature of each text's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sigs = [signature(ngram_set(t.as_py() or "", cache, n)) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.int64())], names=[*b.schema.names, "__sig"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__sig", T.LongType())]))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of linked texts: one with the group's smallest id.

    The texts decide what a group is: of rows with a null or repeated id only
    those that link are one group. A group with no other id is stood for by a
    row with a null id. Where the smallest id has several sets, the smallest
    signature stays. Documents without n-grams link with nothing and all stay.
    """
    _, named = _classes(id_and_text(docs).select(known_id().alias("doc"), "text"), words, percent)
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "sig")).alias("first")
    keep = named.groupBy("root").agg(first).select(
        F.col("first.sig").alias("__sig"), F.coalesce("first.low", F.lit(NULL_ID).cast("bigint")).alias("__doc"))
    blank = F.coalesce(F.col("text"), F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rest = _signed(docs.where(~blank), words).withColumn("__doc", known_id())
    kept = rest.dropDuplicates(["__sig", "__doc"]).join(keep, ["__sig", "__doc"], "left_semi").select(*cols)
    return docs.where(blank).unionAll(kept)


NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t\n\x0B\f\r]+') IF x <> ''] AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), counted AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM counted WHERE 100 * o >= 75 * (an + bn - o)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node WHERE reach.root < edges.b
), low AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, len(s) AS n_shingles, root AS component_id FROM sets JOIN low ON node = doc_id
"""
