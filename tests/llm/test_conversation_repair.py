"""Operator 12 on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from conftest import SF_SMALL

from ventanilla.llm import conversation_repair as cr
from ventanilla.llm.common import read_table

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, code int, conv string, edit string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, rows):
    """Conversations with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "p", 1, "c", "e") for r in rows], SCHEMA)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_edits(rows):
    """(cost, audit, lines) by trying every edit; rows: (role, text, fault)."""
    @lru_cache(None)
    def best(k, done, fresh):
        """Cheapest rest from row k on; done: the last role initial kept ("" at the start)."""
        ways = []
        if k == len(rows) and done in ("", "a"):
            ways.append((0, "", ()))
        turn = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        if fresh < 3:
            c, a, lines = best(k, turn, fresh + 1)
            ways.append((c + 5, "I" + a, (f"{name}:", *lines)))
        if k < len(rows):
            role, text, fault = rows[k]
            c, a, lines = best(k + 1, done, 0)
            ways.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                if role[:1] == turn or role[:1] == "s" and done == "":
                    c, a, lines = best(k + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(k + 1, turn, 0)
                ways.append((c + more + 1, "R" + a, (f"{name}:{text}", *lines)))
        return min(ways) if ways else (10 ** 9, "", ())

    return best(0, "", 0)


def brute(rows, damaged):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in damaged if r[0] == conv],
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, marked = set(), []
        for _, _, role, text in own:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        first = [m[0][:1] for m in marked]
        cost, audit, lines = brute_edits(tuple(marked))
        kinds = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *kinds, illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def report(df, **kw):
    return sorted((tuple(r[c] for c in COLUMNS) for r in cr.repair_report(df, **kw).collect()), key=repr)


def messy(rng, convs, most):
    rows = []
    for conv in range(convs):
        run = rng.random() < 0.3
        role = "user"
        for turn in range(rng.randint(0, most)):
            if not run or rng.random() < 0.1:
                role = rng.choice(["user", "assistant", "system", "tool", "assistant", "user", None, ""])
            rows.append((conv if conv else None, rng.choice([turn, turn + 1, None, turn]), role,
                         rng.choice(["Yes.", "no", " \t", None, "What? ", f"text {turn}!", f"open {turn}", "a.b"])))
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_report_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    rows = messy(random.Random(bits), 60, 24)
    rows += rows[:5]
    rng = random.Random(4)
    rng.shuffle(rows)
    assert report(table(spark, rows)) == brute(rows, brute_damage(rows))


def test_given_table_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert report(read_table(spark, SF_SMALL, "conversations")) == brute(rows, brute_damage(rows))


def test_empty_and_dropped(spark):
    assert report(table(spark, [])) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert report(table(spark, [(gone, 0, "user", "Hi.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", none)]


def test_runs_and_very_long_texts(spark):
    rows = [(1, t, "user", f"{t} is long. ") for t in range(6000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "ok.")]
    got = {r.conv_id: r for r in cr.repair_report(table(spark, rows), damaged=lambda d: d.select("conv_id", "turn", "role", "text")).collect()}
    # of 6000 user turns every second one is named anew
    assert (got[1].cost, got[1].illegal, got[1].audit) == (3000, 5999, "KR" * 3000)
    assert got[2].audit == "KK" and got[2].repaired_sha256 == hashlib.sha256(("user:" + "x" * 3_000_000 + ".\nassistant:ok.").encode()).hexdigest()


def test_powers_of_a_run_equal_single_steps():
    powers = cr.Powers()
    for code in range(12):
        step = cr.END
        for n in range(1, 40):
            step = cr.times(cr.row_matrix(code), step)
            assert (powers.before(code, n, cr.END) == step).all()
    assert cr.runs(np.array([2, 5, 8, 3, 3, 0], "i1")) == [(11, 3), (3, 2), (0, 1)]


def test_repaired_rows_are_the_lines_of_the_digest(spark):
    rows = [(5, 1, "assistant", "Hello."), (5, 2, "user", "cut"), (5, 3, "assistant", "Fine!")]
    got = cr.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("pos", "place").collect()
    want = brute(rows, rows)[0]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == want[-1]
    assert "".join(r.edit for r in got) == want[-2].replace("D", "")
