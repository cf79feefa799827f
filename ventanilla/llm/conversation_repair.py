"""Operator 12, conversation structure repair: a run-length dynamic programme.

The rows of a conversation are a string of symbols (role class and fault).
Equal neighbours are collapsed to runs; the cost of getting through a run is
a power of its symbol's 4 x 4 min-plus matrix, put together from cached binary
powers. The four states are what the repaired roles end in: nothing, a system
turn, a user turn, an assistant turn; the first and the last may end.

A conversation of any length is cut into chunks of at most ``2 ** CHUNK_BITS``
rows in order. Chunk matrices are computed in parallel; a stream over them from the
last to the first gives every chunk the cost vector of what follows, each
chunk then tells where it would end for every start, a stream from the first
to the last picks the starts, and the chunks' edits are unrolled in parallel.
Both streams hold one vector and see one row per chunk. Edits are chosen row by
row: the first letter in ASCII order that lies on a cheapest way.

Defined cases: null ids, turns, roles and texts stand as one space (a null
conversation is one conversation, null turns come first and count in no gap);
rows of one turn are ordered by role, then by the SHA-256 of their text;
repeated rows are duplicates like any other; an empty table gives no rows;
other columns are left out. Texts are told apart by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventanilla.llm.common import known_id, real_id, staged

#: A matrix stands for at most 2 ** CHUNK_BITS rows of a conversation.
CHUNK_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Longer than any cost.
FAR = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads from each state.
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLEAN, CUT_OFF, MUST_GO = range(3)
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER_ROLE = 3


# --- the programme ---------------------------------------------------------------

def edges(code: int) -> list[tuple[str, int, int, int]]:
    """``letter, from, to, cost`` of what may become of one row; code = 3 * role class + fault."""
    role, fault = divmod(code, 3)
    out = [("D", s, s, DELETE) for s in range(4)]
    if fault == MUST_GO:
        return out
    more = TRUNCATED if fault == CUT_OFF else 0
    if role == ROLES["s"]:
        out.append(("K", NOTHING, SYSTEM, KEEP + more))
    for s, to in AFTER.items():
        if role == (ROLES["u"] if to == USER else ROLES["a"]):
            out.append(("K", s, to, KEEP + more))
        out.append(("R", s, to, REROLE + more))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    if b.ndim == 1:
        return np.minimum((a + b).min(1), FAR)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def inserts() -> np.ndarray:
    """Costs of any number of inserted turns."""
    m = np.full((4, 4), FAR)
    for s in range(4):
        m[s, s], to, cost = 0, AFTER[s], INSERT
        while cost < m[s, to]:
            m[s, to] = cost
            to, cost = AFTER[to], cost + INSERT
    return m


ANY_INSERTS = inserts()
#: Costs of ending the conversation in each state.
END = np.minimum(ANY_INSERTS[:, NOTHING], ANY_INSERTS[:, ASSISTANT])


def row_matrix(code: int) -> np.ndarray:
    """Min-plus matrix of one row with any inserts before it."""
    m = np.full((4, 4), FAR)
    for _, s, to, cost in edges(code):
        m[s, to] = min(m[s, to], cost)
    return times(ANY_INSERTS, m)


class Powers:
    """The min-plus matrices of runs, by cached binary powers."""

    def __init__(self):
        self.cache: dict[int, list[np.ndarray]] = {}

    def binary(self, code: int, bit: int) -> np.ndarray:
        own = self.cache.setdefault(code, [row_matrix(code)])
        while len(own) <= bit:
            own.append(times(own[-1], own[-1]))
        return own[bit]

    def before(self, code: int, n: int, after: np.ndarray) -> np.ndarray:
        """The matrix or cost vector before ``n`` rows of one symbol, from the one after them."""
        bit = 0
        while n >> bit:
            if n >> bit & 1:
                after = times(self.binary(code, bit), after)
            bit += 1
        return after


def runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """Symbols and lengths of the runs; rows that must go are one symbol whatever their role."""
    codes = np.where(codes % 3 == MUST_GO, 3 * OTHER_ROLE + MUST_GO, codes)
    return [(int(c), len(list(g))) for c, g in groupby(codes.tolist())]


def chunk_matrix(powers: Powers, codes: np.ndarray) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code, n in reversed(runs(codes)):
        m = powers.before(code, n, m)
    return m


_EDGES = [{(s, letter): (to, cost) for letter, s, to, cost in edges(c)} for c in range(12)]


def row_costs(powers: Powers, codes: np.ndarray, after: np.ndarray) -> list[tuple[dict, list[int], list[int]]]:
    """Per row its edits and the cost vectors before and after it, run by run from the end."""
    blocks = runs(codes)
    ends = [after]
    for code, n in reversed(blocks[1:]):
        ends.append(powers.before(code, n, ends[-1]))
    out = []
    for (code, n), end in zip(blocks, reversed(ends)):
        one, costs = powers.binary(code, 0), [end]
        for _ in range(n):
            costs.append(times(one, costs[-1]))
        lists = [c.tolist() for c in reversed(costs)]
        out += [(_EDGES[code], here, then) for here, then in zip(lists, lists[1:])]
    return out


def unroll(costs: list[tuple[dict, list[int], list[int]]], state: int) -> tuple[list[tuple[str, str, int]], int]:
    """Per row ``(roles inserted before it, letter, state after it)`` and the last state.

    At every step the first letter in ASCII order on a cheapest way.
    """
    out = []
    for ways, here, then in costs:
        new = letter = ""
        while not letter:
            best = here[state]
            if then[state] + DELETE == best:
                letter = "D"
            elif here[AFTER[state]] + INSERT == best:
                state = AFTER[state]
                new += "u" if state == USER else "a"
            else:
                letter, state = next((x, to) for x in "KR" for to, cost in [ways.get((state, x), (state, FAR))] if then[to] + cost == best)
        out.append((new, letter, state))
    return out, state


def closing(state: int) -> str:
    """Roles inserted after the last row."""
    out = ""
    while state not in (NOTHING, ASSISTANT):
        state = AFTER[state]
        out += "u" if state == USER else "a"
    return out


# --- rows and faults ---------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage by ``crc32(conv_id:turn) % 20``; nulls stand as one space."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    d = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spaced("role").alias("role"),
        spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (d.where("_h <> 0").select(
        "conv_id", "turn", F.when(F.col("_h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("_h") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in conversation order over range partitions: ``conv, turn, role, text, digest, pos``, ``pos`` rising; written once.

    Equal rows of one turn may fall into different partitions, so a row
    repeated without end does not fill one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(known_id("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        F.sha2(F.coalesce("text", F.lit(" ")), 256).alias("digest"), F.monotonically_increasing_id().alias("copy"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    return staged(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("copy")
                  .withColumn("pos", F.monotonically_increasing_id()), "conversations")


def faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, pos, code, fault`` of the ordered rows; the first fault counts."""
    ink = F.rtrim("text", F.lit(BLANKS))
    told = rows.select("conv", "turn", "pos", "role", "digest", (ink == "").alias("blank"),
                       (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("cut"))
    firsts = told.where("not blank").groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER_ROLE)
    kind = F.when(F.col("fault").isNull(), CLEAN).when(F.col("fault") == "truncated", CUT_OFF).otherwise(MUST_GO)
    return (told.join(firsts, "pos", "left").withColumn("fault", fault)
            .select("conv", "turn", "pos", (role * 3 + kind).cast("tinyint").alias("code"), "fault"))


def fault_counts(marked: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated``: counted per turn first, so a long conversation is combined before it meets."""
    kinds = ["blank", "duplicate", "truncated"]
    by_turn = marked.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    return by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(k).alias(k) for k in kinds])


# --- chunks --------------------------------------------------------------------------

def _per_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = Powers()
    for b in batches:
        b["matrix"] = [chunk_matrix(powers, c).ravel() for c in b["codes"]]
        role = [c // 3 for c in b["codes"]]
        b["illegal"] = [int((~legal(r[:-1], r[1:])).sum()) for r in role]
        b["first"], b["last"] = [int(r[0]) for r in role], [int(r[-1]) for r in role]
        yield b


def legal(a, b):
    """Adjacent role classes that may stand side by side: su, ua, au."""
    return ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))


def _costs_after(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the last chunk of a conversation to its first: the cost vector of what follows."""
    conv = cost = None
    for b in batches:
        after, final, whole = [], [], []
        for c, m in zip(b["conv"], b.pop("matrix")):
            final.append(c != conv)
            if c != conv:
                conv, cost = c, END
            after.append(cost)
            cost = times(np.asarray(m, "i8").reshape(4, 4), cost)
            whole.append(int(cost[NOTHING]))
        yield b.assign(after=after, final=final, cost=whole)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each chunk ends for each start."""
    powers = Powers()
    for b in batches:
        costs = [row_costs(powers, codes, np.asarray(after, "i8")) for codes, after in zip(b["codes"], b["after"])]
        yield b.assign(ends=[[unroll(c, s)[1] for s in range(4)] for c in costs])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the first chunk of a conversation to its last: its start, and the illegal pair at its border."""
    conv = state = last = None
    for b in batches:
        start, illegal, cost = [], [], []
        for c, ends, f, t, n, whole in zip(b["conv"], b["ends"], b["first"], b["last"], b["illegal"], b["cost"]):
            cost.append(whole if c != conv else 0)
            if c != conv:
                conv, state, last = c, NOTHING, None
            illegal.append(n + (last is not None and not legal(last, f)))
            start.append(state)
            state, last = ends[state], t
        yield b.drop(columns=["ends", "first", "last"]).assign(start=start, illegal=illegal, cost=cost)


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = Powers()
    names = ["", "system", "user", "assistant"]
    for b in batches:
        piece, rows = [], []
        for codes, after, start, final in zip(b["codes"], b["after"], b["start"], b["final"]):
            steps, state = unroll(row_costs(powers, codes, np.asarray(after, "i8")), start)
            tail = closing(state) if final else ""
            piece.append("".join("I" * len(new) + letter for new, letter, _ in steps) + "I" * len(tail))
            rows.append([{"before": new, "edit": letter, "role": names[s] if letter == "R" else None, "after": tail if k == len(steps) - 1 else ""}
                         for k, (new, letter, s) in enumerate(steps)])
        yield b[["conv", "chunk", "illegal", "cost", "positions"]].assign(piece=piece, steps=rows)


def edit_chunks(marked: DataFrame) -> DataFrame:
    """``conv, chunk, illegal, cost, positions, piece, steps`` of every chunk of the marked rows; written once."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "code")))
    chunks = (marked.groupBy("conv", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(pairs.alias("p"))
              .select("conv", "chunk", F.col("p.pos").alias("positions"), F.col("p.code").alias("codes")))
    head = "conv bigint, chunk bigint, positions array<bigint>, codes array<tinyint>, "
    with_matrix = chunks.mapInPandas(_per_chunk, head + "matrix array<bigint>, illegal bigint, first int, last int")
    down = with_matrix.repartition("conv").sortWithinPartitions("conv", F.col("chunk").desc())
    tail = "illegal bigint, first int, last int, after array<bigint>, final boolean, cost bigint"
    costed = down.mapInPandas(_costs_after, head + tail)
    ended = costed.repartition("conv", "chunk").mapInPandas(_ends, head + tail + ", ends array<int>")
    up = ended.repartition("conv").sortWithinPartitions("conv", "chunk")
    started = up.mapInPandas(_starts, head + "illegal bigint, after array<bigint>, final boolean, cost bigint, start int")
    steps = "array<struct<before: string, edit: string, role: string, after: string>>"
    return staged(started.repartition("conv", "chunk").mapInPandas(
        _edits, f"conv bigint, chunk bigint, illegal bigint, cost bigint, positions array<bigint>, piece string, steps {steps}"), "conversation-edits")


def repaired_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv, pos, place, edit, role, text``; inserted turns have an empty text, deleted rows are gone."""
    step = chunks.select(F.explode(F.arrays_zip("positions", "steps")).alias("z")).select(F.col("z.positions").alias("pos"), "z.steps.*")

    def new(col, first):
        roles = F.filter(F.split(F.col(col), ""), lambda r: r != "")
        return F.transform(roles, lambda r, i: F.struct((i + first).cast("int").alias("place"), F.lit("I").alias("edit"),
                                                        F.when(r == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct(F.lit(1000).alias("place"), F.col("edit"), F.coalesce("new_role", "role").alias("role"), F.col("text")))
    own = F.when(F.col("edit") != "D", own).otherwise(F.filter(own, lambda _: F.lit(False)))
    return (rows.join(step.withColumnRenamed("role", "new_role"), "pos")
            .select("conv", "pos", F.inline(F.concat(new("before", 0), own, new("after", 2000)))))


def repair(rows: DataFrame) -> DataFrame:
    """The rows of repaired conversations: ``conv_id, pos, place, edit, role, text``, in the order of ``pos, place``.

    ``rows`` holds ``conv_id, turn, role, text`` as they are; nulls stand as
    one space.
    """
    o = ordered(rows)
    return repaired_rows(o, edit_chunks(faults(o))).select(real_id("conv").alias("conv_id"), "pos", "place", "edit", "role", "text")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines in order; only the running state is held."""
    conv = digest = None
    for b in batches:
        done = []
        for c, role, text in zip(b["conv"], b["role"], b["text"]):
            if c != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pd.DataFrame(done, columns=["conv", "sha"])
    if conv is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "sha"])


def repair_report(conversations: DataFrame, damaged: Callable[[DataFrame], DataFrame] = damage) -> DataFrame:
    """One row per original conversation: faults, cost and audit of its cheapest repair, digest of the result."""
    o = ordered(damaged(conversations))
    marked = staged(faults(o), "conversation-faults")
    chunks = edit_chunks(marked)
    audits = (chunks.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
                                         F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("_p"))
              .select("conv", "illegal", "cost", F.array_join("_p.piece", "").alias("audit")))
    lines = repaired_rows(o, chunks).select("conv", "pos", "place", "role", "text")
    digests = (lines.repartition("conv").sortWithinPartitions("conv", "pos", "place")
               .mapInPandas(_digests, "conv bigint, sha string"))
    every = conversations.select(known_id("conv_id").cast("bigint").alias("conv")).distinct()
    out = every.join(fault_counts(marked), "conv", "left").join(audits, "conv", "left").join(digests, "conv", "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(real_id("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in longs],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
