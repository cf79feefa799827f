"""Embedding near-duplicates by NN-descent.

Random hyperplanes give every vector first neighbours; rounds then compare
the neighbours of each vector with one another and keep the closest. Vectors
whose lists are full of links are searched again for links out of their
component, their components are counted in full, and recall is audited
against brute force on a bounded sample. Where rounds do not reach it, all
vectors of a label are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventanilla.llm.common import connected, schema, staged

#: Fixed value of the registered query.
THRESHOLD = 0.98
#: Neighbours kept per vector; first hash tables; vectors a leaf should hold and may hold.
NEIGHBOURS, TABLES, LEAF, LEAF_MOST = 8, 4, 128, 512
#: Cells an overfull leaf is split into at most, levels of such splits, members that a task assigns.
SPLIT, LEVELS, ASSIGNED = 64, 3, 4096
#: Rounds before all are compared; a round that changes a smaller share of the lists is the last.
ROUNDS, SETTLED = 4, 0.002
#: Vectors with links, and vectors of any kind, audited against brute force; the recall that ends the search.
AUDIT, AUDIT_ANY, RECALL = 200, 4096, 0.97
#: Vectors in a block when saturated lists are enlarged.
BLOCK = 1024


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v, known``: ``known`` marks vectors that can link (non-null label, finite, not zero)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
                          F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists("v", lambda c: c != 0)
    return rows.withColumn("known", F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False)))


def _matrix(col) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that very large or small ones neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in col])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` closest of each row of a similarity matrix as ``(a, b, sim)``."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(sims, at, 1).ravel())],
        names=["a", "b", "sim"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """Groups of rows with equal first ``keys`` columns, from a sorted stream."""
    held = None
    for b in batches:
        t = b.to_pandas()
        t = t if held is None else pd.concat([held, t], ignore_index=True)
        if not len(t):
            continue
        change = (t.iloc[1:, :keys].to_numpy() != t.iloc[:-1, :keys].to_numpy()).any(axis=1)
        cut = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(cut, cut[1:]):
            yield t.iloc[a:z]
        held = t.iloc[cut[-1]:]
    if held is not None and len(held):
        yield held


def _leaves(points: DataFrame, seed: int, tables: int) -> DataFrame:
    """``label, dims, tab, code, cut, node``: vectors on the same side of some random hyperplanes, for several tables.

    A label gets as many planes as bring its leaves to about ``LEAF``; a leaf
    of more than ``LEAF_MOST`` is split by ``_split``.
    """
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("size"))

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = b.to_pandas()
            for (dims, size), g in t.groupby([t["v"].map(len), "size"]):
                x = _matrix(g["v"])
                planes = max(0, math.ceil(math.log2(size / LEAF))) if size > LEAF_MOST else 0
                for table in range(tables):
                    w = np.random.default_rng([seed, table, dims]).standard_normal((dims, planes))
                    code = ((x @ w > 0) @ (1 << np.arange(planes, dtype=np.int64))) if planes else np.zeros(len(g), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g["label"]), pa.array(np.full(len(g), dims)), pa.array(np.full(len(g), table)),
                         pa.array(code), pa.array(g["node"])], names=["label", "dims", "tab", "code", "node"])

    leaves = staged(points.join(sizes, "label").select("label", "size", "node", "v").mapInArrow(
        side, schema("label string, dims bigint, tab bigint, code bigint, node bigint")), "leaves")
    leaves = _split(leaves, points, seed)
    full = leaves.groupBy("label", "dims", "tab", "code").agg(F.ceil(F.count(F.lit(1)) / LEAF_MOST).cast("int").alias("cuts"))
    return (leaves.join(full, ["label", "dims", "tab", "code"])
            .withColumn("cut", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("cuts")))
            .select("label", "dims", "tab", "code", "cut", "node"))


def _split(leaves: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """``leaves`` with overfull ones split: members go to the closest of some drawn by hash, level by level.

    What is overfull after ``LEVELS`` is cut at random.
    """
    keys = ["label", "dims", "tab", "code"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, key = None, None
        for g in _runs(batches, 6):  # label, dims, tab, code, salt, kind (0: drawn)
            now = tuple(g.iloc[0, :5])
            if g.iloc[0, 5] == 0:
                key, drawn = now, (g["node"].to_numpy(np.int64), _matrix(g["v"]))
                continue
            code = g["code"].to_numpy(np.int64)
            if key == now:
                code = drawn[0][(_matrix(g["v"]) @ drawn[1].T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(g["label"]), pa.array(g["dims"]), pa.array(g["tab"]), pa.array(code), pa.array(g["node"])],
                                             names=[*keys, "node"])

    for level in range(LEVELS):
        big = staged(leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LEAF_MOST), "overfull")
        if big.isEmpty():
            break
        held = leaves.join(big, keys).withColumn("salts", F.ceil(F.col("size") / ASSIGNED))
        cells = F.least(F.lit(SPLIT), F.ceil(F.col("size") * 2 / LEAF_MOST))
        drawn = held.where(F.pmod(F.xxhash64("node", F.lit(seed), F.lit(level)), F.col("size")) < cells)
        rows = (drawn.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node")
                .unionAll(held.select(*keys, F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "node")))
        rows = rows.join(points.select("node", "v"), "node").select(*keys, "salt", "kind", "node", "v")
        split = rows.repartition(*keys, "salt").sortWithinPartitions(*keys, "salt", "kind", "node").mapInArrow(
            assign, schema("label string, dims bigint, tab bigint, code bigint, node bigint"))
        leaves = staged(leaves.join(big, keys, "left_anti").select(*keys, "node").unionAll(split), "leaves")
    return leaves


def _first_neighbours(points: DataFrame, seed: int, tables: int, k: int) -> DataFrame:
    """Closest vectors of each leaf."""
    keys = ["label", "dims", "tab", "code", "cut"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, 5):
            if len(g) > 1:
                x = _matrix(g["v"])
                yield _best(g["node"].to_numpy(np.int64), x @ x.T, k)

    placed = _leaves(points, seed, tables).join(points.select("node", "v"), "node").select(*keys, "node", "v")
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, schema("a bigint, b bigint, sim double"))


def _joining(hit: np.ndarray, one: tuple, two: tuple) -> tuple[list, list]:
    """Of the links of two blocks ``(nodes, roots)`` as few as join all the components that they join."""
    i, j = np.nonzero(hit & (one[1][:, None] != two[1][None]))
    if not len(i):
        return [], []
    pairs, first = np.unique(np.stack((one[1][i], two[1][j])), axis=1, return_index=True)
    top: dict[int, int] = {}

    def find(r: int) -> int:
        while top.setdefault(r, r) != r:
            top[r] = r = top[top[r]]
        return r

    a, b = [], []
    for p, q, at in zip(*pairs.tolist(), first.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            top[p] = q
            a.append(int(one[0][i[at]]))
            b.append(int(two[0][j[at]]))
    return a, b


def _across(full: DataFrame, points: DataFrame, seed: int, threshold: float) -> DataFrame:
    """Links ``a, b`` between different components among the vectors ``full (node, root)``, from leaves of fresh tables."""
    keys = ["label", "dims", "tab", "code", "cut"]
    held = staged(full.join(points.select("node", "label", "v"), "node"), "full")
    several = held.groupBy("label").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("label")
    held = held.join(several, "label")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, 5):
            x, own = _matrix(g["v"]), (g["node"].to_numpy(np.int64), g["root"].to_numpy(np.int64))
            a, b = _joining(x @ x.T >= threshold, own, own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = _leaves(held.select("node", "label", "v"), seed, TABLES).join(held.select("node", "root", "v"), "node").select(*keys, "node", "root", "v")
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, schema("a bigint, b bigint"))


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` closest of every vector, of edges seen from both ends."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    best = both.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _round(lists: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of neighbours: each vector's list, itself and those that list it are compared."""
    heard = lists.select(F.col("b").alias("m"), F.col("a").alias("node"), "sim")
    order = Window.partitionBy("m").orderBy(F.col("sim").desc(), "node")
    heard = heard.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("m", "node")
    meet = (lists.select(F.col("a").alias("m"), F.col("b").alias("node")).unionAll(heard)
            .unionAll(lists.select(F.col("a").alias("m"), F.col("a").alias("node"))).distinct()
            .join(points.select("node", "v"), "node").select("m", "node", "v"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = []
        for g in _runs(batches, 1):
            if len(g) > 2:
                x = _matrix(g["v"])
                wait.append(_best(g["node"].to_numpy(np.int64), x @ x.T, k))
            if len(wait) >= 500:
                yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
                wait = []
        if wait:
            yield from pa.Table.from_batches(wait).combine_chunks().to_batches()

    return meet.repartition("m").sortWithinPartitions("m").mapInArrow(near, schema("a bigint, b bigint, sim double"))


def _compared(members: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """All pairs of each group of ``members (grp, root, node)``, block against block.

    Rows ``node, n, other``: the links ``n`` of a node in a block (``other``
    null), and links between different roots, as few as join what they join.
    """
    held = staged(members.join(points.select("node", "v", "copies"), "node").select("grp", "root", "node", "v", "copies"), "full")
    sizes = held.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    cut = held.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")))
    # a block meets every block of its group: one copy of each row per block
    dealt = cut.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "grp", F.col("task").cast("bigint").alias("task"), F.col("own").cast("bigint").alias("own"), "root", "node", "copies", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, key = None, None
        for g in _runs(batches, 4):  # grp, task, other (0: the task's own block), own
            now = (g["node"].to_numpy(np.int64), g["root"].to_numpy(np.int64))
            if g.iloc[0, 2] == 0:
                key, mine = (g.iloc[0, 0], g.iloc[0, 1]), (*now, _matrix(g["v"]))
            if key != (g.iloc[0, 0], g.iloc[0, 1]):
                continue
            hit = mine[2] @ _matrix(g["v"]).T >= threshold
            if g.iloc[0, 2] == 0:
                np.fill_diagonal(hit, False)
            n = hit @ g["copies"].to_numpy(np.int64)
            a, b = _joining(hit, mine, now)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*mine[0].tolist(), *a], pa.int64()), pa.array([*n.tolist(), *[None] * len(a)], pa.int64()),
                 pa.array([*[None] * len(n), *b], pa.int64())], names=["node", "n", "other"])

    keys = ["grp", "task", "other", "own"]
    ordered = dealt.withColumn("other", (F.col("task") != F.col("own")).cast("bigint"))
    return ordered.select(*keys, "root", "node", "copies", "v").repartition("grp", "task").sortWithinPartitions(*keys).mapInArrow(
        count, schema("node bigint, n bigint, other bigint"))


def _counts(compared: DataFrame) -> DataFrame:
    return compared.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))


def _audit(points: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Mean share, per vector, of its links by brute force that the graph counts.

    Up to ``AUDIT_ANY`` vectors of any kind and up to ``AUDIT`` of those that
    have links are looked at; the worse of the two means counts. Vectors
    without a link have no share in a mean.
    """
    order = F.xxhash64("node", F.lit(11))
    some = points.orderBy(order).limit(AUDIT_ANY).select("node", F.lit(0).alias("kind")).unionAll(
        counts.where("n > 0").orderBy(order).limit(AUDIT).select("node", F.lit(1).alias("kind")))
    some = staged(some, "audit")
    asked_rows = some.select("node").distinct().join(points.select("node", "label", "v"), "node").toPandas()
    if not len(asked_rows):
        return 1.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {key: (g["node"].to_numpy(np.int64), _matrix(g["v"]))
                 for key, g in asked_rows.groupby(["label", asked_rows["v"].map(len)])}
        found = {key: np.zeros(len(ids), np.int64) for key, (ids, _) in asked.items()}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                t = b.slice(at, 512).to_pandas()
                for key, g in t.groupby(["label", t["v"].map(len)]):
                    if key in asked:
                        ids, x = asked[key]
                        hit = x @ _matrix(g["v"]).T >= threshold
                        hit &= ids[:, None] != g["node"].to_numpy(np.int64)[None]
                        found[key] += hit @ g["copies"].to_numpy(np.int64)
        for key, n in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[key][0]), pa.array(n)], names=["node", "n"])

    true = points.select("node", "label", "v", "copies").mapInArrow(scan, schema("node bigint, n bigint")).groupBy("node").agg(F.sum("n").alias("n"))
    share = F.least("n", F.coalesce("got", F.lit(0))) / F.col("n")
    got = (some.join(true.where("n > 0"), "node").join(counts.withColumnRenamed("n", "got"), "node", "left")
           .groupBy("kind").agg(F.avg(share).alias("recall")).collect())
    return min([r["recall"] for r in got], default=1.0)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and their cosine, in double
    precision, is at least ``threshold``. Null, zero and unsound vectors,
    vectors of other lengths and null labels link with nothing and are kept,
    null ids too. Equal vectors of one label are one point of the graph with
    so many copies, repeated rows included; each copy counts as a link.
    ``component_id`` is the smallest linked id; an empty table gives no rows;
    other columns are not read. Every link reported holds; the search is
    approximate and ends when the audited recall reaches ``RECALL``; if that
    takes more than ``ROUNDS``, all vectors of a label are compared.
    """
    rows = sound_vectors(vectors, id_col, vector_col, label_col).withColumn(
        "node", F.when(F.col("known"), F.xxhash64("label", "v")))
    points = staged(rows.where("known").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")), "points")
    lists, total, roots, counts = None, points.count() * k, None, None
    for k_round in range(ROUNDS):
        fresh = _first_neighbours(points, 1 + k_round, TABLES, k) if lists is None or k_round > 1 else None
        if lists is None:
            lists = staged(_lists(fresh, k), "lists")
        new = _round(lists, points, k)
        grown = staged(_lists(lists.unionAll(new if fresh is None or k_round == 0 else new.unionAll(fresh)), k), "lists")
        moved = grown.join(lists, ["a", "b"], "left_anti").count()
        lists = grown
        if k_round == 0 and moved > SETTLED * total:
            continue
        edges = staged(lists.where(F.col("sim") >= threshold).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        roots = staged(connected(edges), "roots")
        # a list whose last place is a link may miss others; a link between two lists is missed only where both are full
        full = staged(lists.where(F.col("sim") >= threshold).groupBy("a").count().where(F.col("count") >= k).select(F.col("a").alias("node")), "full-lists")
        joined, seed = edges, 100 * (1 + k_round)
        while True:
            new = staged(_across(roots.join(full, "node").select("node", "root"), points, seed, threshold), "across")
            if new.isEmpty():
                break
            joined, seed = joined.unionAll(new), seed + 1
            roots = staged(connected(joined), "roots")
        wide = staged(roots.join(full, "node").select("root").distinct(), "wide")
        many = _counts(_compared(roots.join(wide, "root").select(F.col("root").alias("grp"), "root", "node"), points, threshold))
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        few = (ends.join(roots.join(wide, "root", "left_anti"), ends["a"] == F.col("node")).select("a", "b")
               .join(points.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
               .select(F.col("a").alias("node"), "n"))
        counts = staged(few.unionAll(many), "counts")
        if _audit(points, counts, threshold) >= RECALL:
            break
    else:
        own = points.join(roots, "node", "left") if roots is not None else points.withColumn("root", F.col("node"))
        members = own.select(F.xxhash64("label", F.size("v")).alias("grp"), F.coalesce("root", "node").alias("root"), "node")
        whole = staged(_compared(members, points, threshold), "compared")
        counts = staged(_counts(whole), "counts")
        links = whole.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
        if roots is not None:
            links = links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = staged(connected(links), "roots")
    named = points.select("node", "copies", "low").join(roots, "node", "left").join(counts, "node", "left").select(
        "node", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    out = rows.select("vec_id", "node").join(named.join(lows, "root").select("node", "n_links", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


COSINE_SQL = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN embedding IF c <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), low AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON node = vec_id LEFT JOIN counts ON a = vec_id
"""
