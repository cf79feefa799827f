"""Operator 13, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Sources get targets by weight, at most three times what they hold; the excess
goes to the others by weight. Every source's documents are dealt by hash into
blocks, so a block is a random part of its source. A source's quota is an exact
number of words: whole epochs over all its blocks, then blocks in permuted order
until the words are reached, the last block and its last document cut.

The draws (block, epoch) are split among output shards of equal numbers of
draws by a tree: at every node the shards are halved and the sources' counts for
the left half come from one multivariate-hypergeometric draw. With many sources
the tree runs twice, over groups of sources and inside each group, so no vector
holds more than a group or the list of groups. A source's permuted draws are
then handed out in slices of those counts, and each shard is shuffled locally.

All randomness is a hash or a generator seeded by what it decides, so reruns
agree, however the tables are partitioned.

Defined cases: null texts have size 0 and are taken 0 words; a null source is
one source, the last; a null id is an id like others; rows equal in id, source,
size and text (by a 64-bit hash) are copies that a cut takes one after another;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ventanilla.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: Words of a block, where a source has fewer than ``MOST_BLOCKS`` of them.
BLOCK_WORDS = 20_000
#: Blocks of a source at most (larger sources get larger blocks), and of all sources together.
MOST_BLOCKS, MOST_DRAWS = 4096, 1 << 28
#: Draws of an output shard.
SHARD_DRAWS = 64
#: Sources of a group in the splitting tree.
GROUP = 1024
SEED = 13
#: Seed of the tree over groups; the trees inside groups have the group's number.
GROUPS = 1 << 40


def _hash(salt: str, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(f"{SEED}:{salt}"), *cols)


def items(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key, copies``: distinct documents with their number of words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), text_key().alias("key"))
            .groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")))


def text_key() -> Column:
    return _hash("text", F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))


# --- sources and targets -----------------------------------------------------------

def numbered_sources(found: DataFrame) -> DataFrame:
    """``source, source_size, no``: numbers from 0 in code-point order, null last, without one task for all."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    sizes = staged(found.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), "mix-sizes")
    at = staged(sizes.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    offsets, total = [], 0
    for r in at.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per range partition
        offsets.append((r["part"], total))
        total += r["count"]
    known = found.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    return at.join(F.broadcast(known), part == F.col("part")).select("source", "source_size", (F.col("offset") + place).alias("no"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Adds ``weight, target``: the fill level of all targets is found by rounds of one exact aggregation each.

    A round takes the sources at their limit out and shares the rest anew; it
    ends when no further source reaches its limit.
    """
    wide = "decimal(19,0)"
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    s = staged(sources.withColumn("weight", weight.cast("bigint")).withColumn("_limit", F.lit(most) * F.col("source_size")), "mix-weights")
    all_words, rest_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    rest = all_words = int(all_words or 0)
    rest_weight = int(rest_weight or 1)
    while True:
        full = F.col("_limit").cast(wide) * F.lit(rest_weight).cast(wide) <= F.lit(rest).cast(wide) * F.col("weight").cast(wide)
        taken, left = s.agg(F.sum(F.when(full, F.col("_limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (all_words - int(taken or 0), int(left or 0))
        if now == (rest, rest_weight) or not now[1]:
            break
        rest, rest_weight = now
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(rest_weight))
    return s.withColumn("target", F.when(full, F.col("_limit").cast("double")).otherwise(share)).drop("_limit")


def quotas(sources: DataFrame) -> DataFrame:
    """Adds ``epochs, rest, blocks``: whole passes and words of the last one, and the number of blocks."""
    size = F.col("source_size")
    quota = F.round("target").cast("bigint")
    most = min(MOST_BLOCKS, max(1, MOST_DRAWS // max(sources.count(), 1)))
    epochs = F.when(size > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("bigint")
    return (sources.withColumn("epochs", epochs).withColumn("rest", quota - F.col("epochs") * size)
            .withColumn("blocks", F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(size / BLOCK_WORDS))).cast("bigint")))


# --- the splitting tree ---------------------------------------------------------------

def split_tree(counts: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Deal ``counts`` of each kind to shards of the given ``room``: a matrix (kind, shard) with exactly these sums.

    Halves the shards; each node's left part is one multivariate-hypergeometric draw.
    """
    out = np.zeros((len(counts), len(room)), "i8")
    before = np.concatenate(([0], np.cumsum(room)))
    nodes = [(0, len(room), np.asarray(counts, "i8"))]
    while nodes:
        lo, hi, own = nodes.pop()
        if hi - lo == 1:
            out[:, lo] = own
        elif own.any():
            mid = (lo + hi) // 2
            rng = np.random.default_rng((SEED, seed, lo, hi))
            left = rng.multivariate_hypergeometric(own, int(before[mid] - before[lo]), method="marginals")
            nodes += [(lo, mid, left), (mid, hi, own - left)]
    return out


def shard_room(draws: int, shards: int) -> np.ndarray:
    """Draws of every shard: as equal as whole numbers can be."""
    return np.diff(np.arange(shards + 1) * draws // shards)


def _split_groups(draws: int, shards: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches), ignore_index=True)
        if len(g):
            g = g.sort_values("grp", ignore_index=True)
            m = split_tree(g["draws"].to_numpy(), shard_room(draws, shards), GROUPS)
            k, shard = np.nonzero(m)
            yield pd.DataFrame({"grp": g["grp"].to_numpy()[k], "shard": shard, "room": m[k, shard]})
    return run


def _split_sources(key: tuple, own: pd.DataFrame, rooms: pd.DataFrame) -> pd.DataFrame:
    own, rooms = own.sort_values("no", ignore_index=True), rooms.sort_values("shard", ignore_index=True)
    m = split_tree(own["draws"].to_numpy(), rooms["room"].to_numpy(), int(key[0]))
    k, j = np.nonzero(m)
    offset = (np.cumsum(m, axis=1) - m)[k, j]
    return pd.DataFrame({"no": own["no"].to_numpy()[k], "shard": rooms["shard"].to_numpy()[j], "first": offset, "n": m[k, j]})


def shard_counts(per_source: DataFrame, shard_draws: int = SHARD_DRAWS) -> DataFrame:
    """``no, shard, first, n``: the slice of each source's permuted draws that a shard gets; ``per_source(no, draws)``."""
    per_source = per_source.where("draws > 0").withColumn("grp", F.floor(F.col("no") / GROUP))
    draws = int(per_source.agg(F.sum("draws")).first()[0] or 0)
    shards = max(1, -(-draws // shard_draws))
    groups = per_source.groupBy("grp").agg(F.sum("draws").alias("draws"))
    rooms = groups.coalesce(1).mapInPandas(_split_groups(draws, shards), "grp bigint, shard bigint, room bigint")
    return (per_source.groupBy("grp").cogroup(rooms.groupBy("grp"))
            .applyInPandas(_split_sources, "no bigint, shard bigint, first bigint, n bigint"))


# --- blocks and documents ----------------------------------------------------------------

def mix_plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, placed, blocks)`` of the mix, each written once.

    ``placed``: items with ``no, block, epochs`` and ``extra``, the words of all
    their copies in the last epoch. ``blocks``: ``no, block, words, epochs, part``,
    ``part`` the block's words in the last epoch.
    """
    found = staged(items(docs), "mix-items")
    sources = staged(quotas(with_targets(numbered_sources(found))), "mix-targets")
    own = found.join(sources.select(F.col("source").alias("_s"), "no", F.col("blocks").alias("_b")), F.col("source").eqNullSafe(F.col("_s")))
    dealt = staged(own.withColumn("block", F.pmod(_hash("block", "key"), F.col("_b"))).drop("_s", "_b"), "mix-dealt")
    by_block = dealt.groupBy("no", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).where("words > 0")
    # at most MOST_BLOCKS rows of a source meet in this window
    order = Window.partitionBy("no").orderBy(_hash("order", "no", "block"), "block")
    before = F.sum("words").over(order) - F.col("words")
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    blocks = staged(by_block.withColumn("before", before).join(sources.select("no", "epochs", "rest"), "no")
                    .select("no", "block", "words", "epochs", part.cast("bigint").alias("part")), "mix-blocks")
    inside = dealt.join(blocks.withColumnRenamed("words", "_words"), ["no", "block"], "left")
    whole = F.col("size") * F.col("copies")
    cut = F.coalesce((F.col("part") > 0) & (F.col("part") < F.col("_words")), F.lit(False))
    # one cut block per source
    inner = Window.partitionBy("no", "block").orderBy(_hash("cut", "key"), "key", "doc_id", "size")
    extra = F.greatest(F.lit(0), F.least(whole, F.col("part") - (F.sum(whole).over(inner) - whole)))
    placed = (inside.where(~cut).withColumn("extra", F.when(F.col("part") > 0, whole).otherwise(F.lit(0)))
              .unionByName(inside.where(cut).withColumn("extra", extra)))
    return sources, staged(placed.select("doc_id", "source", "size", "key", "copies", "no", "block", F.coalesce("epochs", F.lit(0)).alias("epochs"),
                                         F.col("extra").cast("bigint").alias("extra")), "mix-placed"), blocks


def _each_copy(placed: DataFrame) -> DataFrame:
    """One row per copy with ``copy`` and ``last``, its words in the last epoch."""
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("copy") * F.col("size")))
    return (placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
            .withColumn("last", last.cast("bigint")))


def _pieces(placed: DataFrame, blocks: DataFrame, per_shard: int) -> DataFrame:
    """One row per copy and drawn epoch: its words, its shard and ``place``, by which the shard is shuffled."""
    copies = _each_copy(placed.where("size > 0"))
    words = F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.col("last"))
    return (copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs")))).withColumn("words", words).where("words > 0")
            .join(shard_draws(blocks, per_shard), ["no", "block", "epoch"]).withColumn("place", _hash("place", "key", "copy", "epoch")))


def mix_report(docs: DataFrame, per_shard: int = SHARD_DRAWS) -> DataFrame:
    """Per document its size, its source's size and target, the words that the shards of the mix hold of it (``taken``),
    and where the mix has it first: ``first_shard`` and its row there, ``first_place``, from 0; null if nowhere."""
    sources, placed, blocks = mix_plan(docs)
    shuffled = Window.partitionBy("shard").orderBy("place", "key", "copy", "epoch")  # a shard is a few blocks
    row = F.row_number().over(shuffled).cast("bigint") - 1
    mine = ["no", "doc_id", "size", "key", "copy"]
    drawn = _pieces(placed, blocks, per_shard).select(*mine, "words", (F.shiftleft(F.col("shard"), 32) + row).alias("at"))
    none = _each_copy(placed).select(*mine, F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("at"))
    per_copy = none.unionByName(drawn).groupBy(*mine).agg(F.sum("words").alias("taken"), F.min("at").alias("at"))
    return (per_copy.join(sources.select("no", "source_size", "target"), "no")
            .select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"),
                    F.shiftright("at", 32).alias("first_shard"), F.col("at").bitwiseAND((1 << 32) - 1).alias("first_place")))


def shard_draws(blocks: DataFrame, per_shard: int = SHARD_DRAWS) -> DataFrame:
    """``no, block, epoch, shard``: every draw of a block and the output shard it goes to; written once."""
    drawn = blocks.withColumn("draws", F.col("epochs") + (F.col("part") > 0).cast("bigint"))
    per_source = staged(drawn.groupBy("no").agg(F.sum("draws").alias("draws")), "mix-quotas")
    slices = shard_counts(per_source, per_shard)
    places = slices.select("no", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("place"))
    # at most (MOST_TIMES + 1) * MOST_BLOCKS draws of a source
    order = Window.partitionBy("no").orderBy(_hash("draw", "no", "block", "epoch"), "block", "epoch")
    listed = (drawn.where("draws > 0").select("no", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1)).alias("epoch"))
              .withColumn("place", F.row_number().over(order).cast("bigint") - 1))
    return staged(listed.join(places, ["no", "place"]).select("no", "block", "epoch", "shard"), "mix-draws")


def mix_documents(docs: DataFrame, per_shard: int = SHARD_DRAWS) -> DataFrame:
    """The mix itself: ``shard, place, doc_id, source, epoch, words, text``, sorted by shard and place.

    A document comes once per epoch; a cut one ends with its last taken word.
    """
    _, placed, blocks = mix_plan(docs)
    taken = _pieces(placed, blocks, per_shard)
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"))
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")).otherwise(F.col("text"))
    out = taken.join(texts, "key").select("shard", "place", "doc_id", "source", "epoch", "words", text.alias("text"))
    return out.repartition("shard").sortWithinPartitions("shard", "place")
