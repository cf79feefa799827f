"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are cut into blocks; each block has postings by (dimension, quantised
value). A query reads a block's postings by falling impact and stops when the
bounds prove which vectors can still be among its best; those are rescored
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventanilla.llm.common import schema, staged

#: Fixed values of the registered query: scale of a component, results per query, queries' divisor.
SCALE, K, EVERY = 256, 5, 50
#: Vectors and queries in a block; low bits of a component that a posting's value leaves out.
BLOCK, QUERY_BLOCK, SHIFT = 16384, 128, 3
#: Vectors with a larger component or more dimensions are wide: they have blocks of their own,
#: scored in as many bits as it takes; inner products of the others stay in 64 bits.
LIMIT, DIMS = 2 ** 23, 2 ** 14
#: Shares of the postings after which the bounds are looked at; so few vectors are rescored at once.
LOOKS, FEW = (0.5, 0.7, 0.85, 1.0), 256


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x array<double>`` with ``floor(scale * component)`` in double precision.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. A component that leaves double precision
    when scaled is an error.
    """
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    over = F.raise_error(F.lit("top_k: a scaled component leaves double precision")).cast("double")

    def floor(c: Column) -> Column:
        y = c * float(scale)  # from 2**53 on a double is whole
        return (F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double"))
                .when(F.abs(y) == F.lit(float("inf")), over).otherwise(y))

    whole = F.transform("v", floor)
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
                           F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where("vec_id is not null and v is not null").where(~bad).select("vec_id", whole.alias("x")))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``block, d, wide, ids, x``: up to ``size`` vectors as one matrix, shorter ones filled with zeros.

    The matrix is of int32, that of wide vectors of doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held = {False: ([], []), True: ([], [])}

        def block(wide: bool) -> pa.RecordBatch:
            ids, xs = held[wide]
            d = max(map(len, xs))
            x = np.zeros((len(xs), d), "<f8" if wide else "<i4")
            for row, v in zip(x, xs, strict=True):
                row[:len(v)] = v
            held[wide] = ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()), pa.array([d], pa.int32()), pa.array([wide]),
                 pa.array([np.asarray(ids, "<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["block", "d", "wide", "ids", "x"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                wide = len(v) > DIMS or bool(len(v) and np.abs(v).max() > LIMIT)
                ids, xs = held[wide]
                ids.append(i)
                xs.append(v if wide else v.astype("<i4"))
                if len(ids) == size:
                    yield block(wide)
                    made += 1
        for wide in held:
            if held[wide][0]:
                yield block(wide)
                made += 1

    return rows.mapInArrow(run, schema("block bigint, d int, wide boolean, ids binary, x binary"))


def wide_top(ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """What ``ImpactIndex.top`` gives, for components of any size.

    Scores in double precision with a bound on their error leave those that
    can be among the best; these are scored exactly, beyond 64 bits in
    Python's integers.
    """
    d = min(x.shape[1], len(q))
    x, q = x[:, :d].astype(np.float64), q[:d].astype(np.float64)
    others = ids != qid
    need = min(k, int(others.sum()))
    if not need:
        return []
    with np.errstate(over="ignore", invalid="ignore"):
        near, size = x @ q, np.abs(x) @ np.abs(q)
        room = size * ((d + 2) * 2.0 ** -52)
    possible = others
    if np.isfinite(near).all() and np.isfinite(size).all():
        low = (near - room)[others]
        possible = others & (near + room >= np.partition(low, len(low) - need)[len(low) - need])
    at = np.flatnonzero(possible)
    if size.max() < 2.0 ** 62 and max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < 2.0 ** 62:
        score = (x[at].astype(np.int64) @ q.astype(np.int64)).tolist()
    else:
        whole = [int(c) for c in q]
        score = [sum(int(c) * w for c, w in zip(row, whole, strict=True) if c and w) for row in x[at].tolist()]
    best = sorted(zip((-s for s in score), ids[at].tolist(), strict=True))[:k]
    return [(i, -s) for s, i in best]


class ImpactIndex:
    """Postings of one block: a segment is the vectors of one quantised value in one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, shift: int = SHIFT) -> None:
        self.ids, self.x, self.shift = ids, x, shift
        dims, values, starts, ends, posts, at = [], [], [], [], [], 0
        for d in range(x.shape[1]):
            level = x[:, d] >> shift
            order = np.argsort(level, kind="stable")
            level = level[order]
            first = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
            dims.append(np.full(len(first), d))
            values.append(level[first].astype(np.int64) << shift)
            starts.append(at + first)
            ends.append(at + np.append(first[1:], len(level)))
            posts.append(order)
            at += len(level)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.dims, self.values, self.starts, self.ends, self.posts = map(join, (dims, values, starts, ends, posts))

    def top(self, qid: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The exact ``k`` best ``(id, score)`` of the block, without ``qid``; ties to the smaller id."""
        d, n = self.x.shape[1], len(self.ids)
        q = np.pad(q[:d], (0, max(0, d - len(q)))).astype(np.int64)
        gain = q[self.dims] * self.values
        order = np.argsort(-np.abs(gain), kind="stable")
        # what the low bits can add: 0 to 2**shift - 1 times the query's component
        slack = q * ((1 << self.shift) - 1)
        over, under = int(slack[slack > 0].sum()), int(slack[slack < 0].sum())
        acc = np.zeros(n, np.int64)
        others = self.ids != qid
        need = min(k, int(others.sum()))
        if not need:
            return []
        done, possible = 0, others
        starts, ends, posts, amounts = self.starts.tolist(), self.ends.tolist(), self.posts, gain.tolist()
        for share in LOOKS:
            stop = len(order) if share == 1.0 else int(len(order) * share)
            for s in order[done:stop].tolist():
                acc[posts[starts[s]:ends[s]]] += amounts[s]
            done = stop
            rest = order[done:]
            high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
            np.maximum.at(high, self.dims[rest], gain[rest])
            np.minimum.at(low, self.dims[rest], gain[rest])
            least = np.partition(acc[others], len(acc[others]) - need)[len(acc[others]) - need] + int(low.sum()) + under
            possible = others & (acc + int(high.sum()) + over >= least)
            if int(possible.sum()) <= FEW:
                break
        at = np.flatnonzero(possible)
        score = self.x[at].astype(np.int64) @ q
        best = np.lexsort((self.ids[at], -score))[:k]
        return [(int(self.ids[at[i]]), int(score[i])) for i in best]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best vectors by integer inner product for each id divisible by ``every``.

    ``query_id, rank, vec_id, score``; ranks from 1, ties to the smaller id; a
    vector is no candidate of its own id. Missing dimensions count as zero.
    Null or unsound vectors and null ids take no part; equal query rows are
    answered once, repeated candidate rows each count; with fewer candidates
    all are returned; an empty table gives no rows; other columns are not
    read. Components of any size count in full; a score in the result that
    does not fit a bigint is an error. Queries and vectors meet block by
    block: a group of vector blocks gets every query block once.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale, id_col, vector_col)
    own = staged(_blocks(rows, BLOCK), "vector-blocks")
    asked = staged(_blocks(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"]), QUERY_BLOCK), "query-blocks")
    groups = max(1, min(own.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    left = own.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), "block", "d", "wide", "ids", "x")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"),
                         F.col("d").alias("qd"), F.col("wide").alias("qwide"), F.col("ids").alias("qids"), F.col("x").alias("qx"))

    def matrix(d, wide, ids, x) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids.as_buffer(), "<i8")
        return ids, np.frombuffer(x.as_buffer(), "<f8" if wide.as_py() else "<i4").reshape(len(ids), d.as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, index = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                block, d, wide, ids, x, qd, qwide, qids, qx = (b.column(c)[i] for c in range(9))
                if block.as_py() != now:
                    own = matrix(d, wide, ids, x)
                    index = None if wide.as_py() else ImpactIndex(*own)
                    now = block.as_py()
                out: list[tuple] = []
                for qid, q in zip(*matrix(qd, qwide, qids, qx), strict=True):
                    best = wide_top(*own, qid, q, k) if wide.as_py() or qwide.as_py() else index.top(qid, q, k)
                    # beyond bigint: the largest are among the best of all; of the others the rank may do without the score
                    if best and best[0][1] >= 2 ** 63:
                        raise OverflowError(f"top_k: the score of query {qid} and vector {best[0][0]} does not fit a bigint")
                    out += [(qid, vec, score if score >= -2 ** 63 else None) for vec, score in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    # little to read but much to do: fixed tasks, which adaptive execution does not merge
    tasks = 4 * groups
    found = left.repartition(tasks, "g").join(right.repartition(tasks, "g"), "g").select(
        "block", "d", "wide", "ids", "x", "qd", "qwide", "qids", "qx").mapInArrow(
        run, schema("query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    small = F.raise_error(F.lit("top_k: a score does not fit a bigint")).cast("bigint")
    return best.select("query_id", "rank", "vec_id", F.coalesce("score", small).alias("score"))


TOP_SQL = r"""
WITH sound AS (
  SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
