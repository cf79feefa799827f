"""Operator 11 on small tables, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ventanilla.llm import spelling

DOCS = "doc_id bigint, text string, word string, no bigint, n bigint, at string, path string"


def docs(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "w", 1, 2, "a", "p") for i, t in rows], DOCS)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=199, least_count=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}
    return sorted(brute_groups(n))


def brute_groups(n):
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_words_of_one_edit(spark):
    rng = random.Random(11)
    base = ["banana", "bananas", "Straße", "äöüßàé", "××÷÷××", "aaaaaa", "abcabcabc"]
    words = {}
    for w in base:
        words[w.lower() if w.isascii() else w] = rng.choice([5, 30, 700])
        for _ in range(60):
            v = list(w)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(v))
                v[i:i + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice("abcé")]])
            if len(v) >= 3:
                words.setdefault("".join(v).lower(), rng.choice([5, 6, 25, 26, 130, 900]))
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert got(spelling.group_variants(df)) == sorted(brute_groups(words))


def test_whole_report_with_slips(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, k]), " ".join(rng.choice(["Grundstück", "lighthouse", "LIGHTHOUSES", "lighthause", "kitten"]) for _ in range(300)))
            for k in range(40)]
    rows += [(7, None), (8, ""), (9, "x1y2 \n..")] + rows[:2]
    counted = spelling.word_counts(docs(spark, rows), slip_every=7)
    assert got(spelling.group_variants(counted)) == brute(rows, every=7)
    assert got(spelling.spelling_report(docs(spark, rows))) == brute(rows)


def test_empty_and_very_long(spark):
    assert spelling.spelling_report(docs(spark, [])).count() == 0
    assert spelling.spelling_report(docs(spark, [(1, None), (2, "")])).count() == 0
    long = "ab" * 10_000
    rows = [(i, f"{long} {long[:-1]}") for i in range(5)] + [(i, long) for i in range(5, 35)]
    want = brute(rows)
    assert [(w, f, c) for w, f, _, _, c, _ in want] == [(long[:-1], long, 1), (long, None, 1)]
    assert got(spelling.spelling_report(docs(spark, rows))) == want


def test_node_numbers_are_one_per_prefix(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    df = spelling.ranked(spark.createDataFrame([(w,) for w in words], "word string"), "test-ranked")
    assert df.select(F.shiftright("at", 33)).distinct().count() > 2
    paths = {r.no: list(r.path) for r in spelling.trie_paths(df.withColumn("no", F.col("at"))).collect()}
    node = {}
    for r in df.collect():
        assert len(paths[r.at]) == len(r.word)
        for d, k in enumerate(paths[r.at], 1):
            assert node.setdefault(r.word[:d], k) == k
    assert len(set(node.values())) == len(node)


def test_groups_over_batches():
    rows = sorted([(1, 1, 1, 5, 9), (1, 1, 2, 6, 9), (1, 1, 0, 4, 2), (2, 1, 2, 4, 2), (2, 3, 1, 1, 1), (2, 3, 1, 2, 1)],
                  key=lambda r: (r[0], r[1], -r[4], r[3]))
    no, near_, n, best = spelling.near_of_groups(*(np.array(c) for c in zip(*rows)))
    assert list(zip(no, near_, n, best)) == [(5, 1, 9, 6), (6, 2, 9, 5), (4, 1, 9, 6), (1, 1, 1, 2), (2, 1, 1, 1)]
