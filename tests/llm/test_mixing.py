"""Operator 13 on small tables: exact targets, quotas, shards and texts."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from ventanilla.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string, no bigint, key string, target string, block int"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "s", 1, "k", "t", 2) for r in rows], DOCS).repartition(parts)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Weights by code point, limits of three times the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        target = {s: Fraction(3 * sizes[s]) if s in full else Fraction(rest * weight[s], total) for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def corpus(seed, sources):
    rng = random.Random(seed)
    rows = []
    for k in range(260):
        text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 40, 200])))
        rows.append((k, rng.choice([text, text + "\n", "\t" + text]), rng.choice(sources)))
    rows += [(None, None, None), (None, "one two", None), (1000, None, "only null"), (1001, "", "tiny"), (1002, "a", "tiny")]
    return rows + rows[:7] + [(5, "again another text", "a")]


@pytest.mark.parametrize("sources", [["a"] * 8 + ["b", "é", "Z", None], [f"s{k}" for k in range(40)]])
def test_targets_and_taken_words(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    rows = corpus(len(sources), sources)
    got = mixing.mix_report(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = brute_targets(sizes)
    by_pair = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_pair[r.source_size, r.target] += r.taken
    want = defaultdict(int)
    for s, t in target.items():
        want[sizes[s], float(t)] += round(float(t) + 1e-9)
    assert by_pair.keys() == want.keys()
    assert all(abs(by_pair[k] - want[k]) <= 3 for k in want)
    # at most one document of a source is cut
    cut = Counter((r.source_size, r.target) for r in got if r.size and r.taken % r.size)
    assert all(n <= sum(float(t) == k[1] for t in target.values()) for k, n in cut.items())
    again = mixing.mix_report(docs(spark, rows[::-1], parts=7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_split_tree_keeps_both_sums():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 40, rng.integers(1, 30))
        room = mixing.shard_room(int(counts.sum()), int(rng.integers(1, 20)))
        m = mixing.split_tree(counts, room, 5)
        assert (m.sum(1) == counts).all() and (m.sum(0) == room).all() and (m >= 0).all()
        assert (m == mixing.split_tree(counts, room, 5)).all()
    # the first half of the shards gets its share of every kind, not only the first kinds
    m = mixing.split_tree(np.full(10, 1000), mixing.shard_room(10_000, 10), 0)
    assert m.min() > 50 and m.max() < 160


def test_mix_holds_what_the_report_says(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = corpus(2, ["a"] * 5 + ["b", "c", "d", None])
    df = docs(spark, rows)
    taken = Counter()
    for r in mixing.mix_report(df).collect():
        taken[r.doc_id] += r.taken
    texts = defaultdict(set)
    for d, t, _ in rows:
        texts[d].add(t)
    mix = mixing.mix_documents(df, per_shard=4).collect()
    got = Counter()
    for r in mix:
        got[r.doc_id] += r.words
        assert words(r.text) == r.words and any((t or "").startswith(r.text) for t in texts[r.doc_id])
    assert +taken == got
    assert len({r.shard for r in mix}) > 5
    _, _, blocks = mixing.mix_plan(df)
    draws = mixing.shard_draws(blocks, 4).collect()
    assert max(Counter((r.no, r.block, r.epoch) for r in draws).values()) == 1
    per_shard = Counter(r.shard for r in draws)
    assert set(per_shard.values()) <= {3, 4} and sum(per_shard.values()) == sum(b.epochs + (b.part > 0) for b in blocks.collect())


def test_empty_and_sizeless(spark):
    assert mixing.mix_report(docs(spark, [])).count() == 0
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.mix_report(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix_documents(docs(spark, [(1, None, "a")])).count() == 0


def test_very_long_and_hot(spark):
    rows = [(1, "w " * 400_000, "a")] + [(2, "same text", "b")] * 3000 + [(3, "x y z", "c")]
    got = mixing.mix_report(docs(spark, rows)).collect()
    total = sum(r.size for r in got)
    assert total == 406_003 and {(r.target) for r in got if r.doc_id == 3} == {9.0}
    assert sum(r.taken for r in got if r.doc_id == 2) == 18_000 and [r.taken for r in got if r.doc_id == 1] == [total - 18_009]


def test_report_comes_from_the_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    df = docs(spark, [(k, "w " * (k % 9), "abc"[k % 3]) for k in range(300)])
    held = defaultdict(list)
    for r in mixing.mix_documents(df, per_shard=4).collect():
        held[r.shard].append(r)
    first, taken = {}, Counter()
    for shard in sorted(held):
        for place, r in enumerate(sorted(held[shard], key=lambda r: r.place)):
            first.setdefault(r.doc_id, (shard, place))
            taken[r.doc_id] += r.words
    got = mixing.mix_report(df, per_shard=4).collect()
    assert len(held) > 3
    assert {r.doc_id: (r.first_shard, r.first_place) for r in got if r.taken} == first
    assert all(r.taken == taken[r.doc_id] and (r.taken > 0) == (r.first_shard is not None) for r in got)
