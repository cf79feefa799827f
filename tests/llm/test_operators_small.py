"""The training-data operators on small hand-made tables, against brute force."""



import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ventanilla.llm import (line_dedup, ngram_join, nn_descent, packing, pii, sentencepiece_fst, suffix_dedup, topk_search,
                            toxicity, url_filter)
from ventanilla.llm.common import connected

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, h1 string, n bigint, sig string, words string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)


def out(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (4, "same text twice"), (4, "same text twice"), (5, "same text twice")]


# --- 1 -----------------------------------------------------------------------

def brute_pii(text):
    got = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    got += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            got.append(("card", *m.span()))
    got += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return got


def test_pii_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", "-", " ", "1", "255", "256", "4944339490429605", "+1 (262) 555-3752", "é", "x", "\n", "+", "(", ")", "0", "12.3.4.5", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
        assert base == brute_pii(text), text


def test_pii_added_kinds_need_their_checksum_or_context():
    assert [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert not [s for s in pii.find_spans("IBAN GB83 WEST 1234 5698 7654 32 now") if s[0] == "iban"]
    assert [s[0] for s in pii.find_spans("social security 123-45-6789.")] == ["ssn"]
    assert not [s for s in pii.find_spans("serial 123-45-6789") if s[0] == "ssn"]
    long = "1" * 50_000 + " " + "a" * 50_000 + "." * 1000 + "+" * 1000
    assert [s for s in pii.find_spans(long) if s[0] in ("email", "ip")] == []


def test_pii_report_edges(spark):
    got = pii.pii_report(docs(spark, EDGES + [(6, "write a.b@c.de")]))
    empty = hashlib.sha256(b"").hexdigest()
    assert out(got.where("doc_id <= 3"), "doc_id", "n_email", "base_sha256", "spans") == [(i, 0, empty, "") for i in (1, 2, 3)]
    assert out(got.where("doc_id = 6"), "n_email", "spans") == [(1, "email:6:14")]
    assert got.count() == len(EDGES) + 1 and pii.pii_report(docs(spark, [])).count() == 0
    assert out(pii.redact_documents(docs(spark, [(6, "write a.b@c.de now"), (7, None)])), "doc_id", "text") == [(6, "write <EMAIL> now"), (7, None)]


# --- 2 -----------------------------------------------------------------------

def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    res = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        res.append(" ".join(t))
    return res


def test_ngram_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = near_copies(60, 80, 6, 1) + near_copies(15, 12, 2, 2) + near_copies(10, 300, 30, 3)
    texts += [f"only{i} words{i} here{i}" for i in range(5)] + ["Only0 words0 here0", "one", "ONE"]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randrange(99)}" for _ in range(k)) for k in range(0, 40, 4)]
    rows = [(i, t) for i, t in enumerate(texts)] + EDGES[:4] + [(1000, texts[0]), (1000, texts[0])]
    want = brute_groups(rows)
    assert out(ngram_join.near_duplicate_groups(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(ngram_join, "PIVOTS", ())  # everything by the full comparison, in many blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    assert out(ngram_join.near_duplicate_groups(docs(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_ngram_empty_table_and_keeping_one(spark):
    assert ngram_join.near_duplicate_groups(docs(spark, [])).count() == 0
    rows = [(i, t) for i, t in enumerate(near_copies(8, 60, 1, 5))] + [(20, None), (21, ""), (22, None), (0, near_copies(8, 60, 1, 5)[0])]
    kept = ngram_join.keep_one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "h1", "n", "sig", "words"]
    assert out(kept, "doc_id") == [(0,), (20,), (21,), (22,)]


def test_keeping_one_goes_by_text_where_ids_are_null_or_repeated(spark):
    copies = near_copies(4, 60, 1, 6)
    rows = EDGES + [(None, "another null id"), (None, "another null id"), (None, "same text twice"), (4, "an unrelated text under id 4"),
                    (None, copies[0]), (7, copies[1]), (6, copies[2]), (6, copies[3]), (6, "one more text")]
    kept = out(ngram_join.keep_one_of_each(docs(spark, rows)), "doc_id", "text")
    six = [r for r in kept if r[1] in copies]
    assert len(six) == 1 and six[0] in [(6, copies[2]), (6, copies[3])]
    want = [*EDGES[:4], (None, "another null id"), (4, "same text twice"), (4, "an unrelated text under id 4"), (6, "one more text")]
    assert [r for r in kept if r not in six] == sorted(want, key=repr)


def test_ngrams_that_share_low_bits_of_their_hash_differ(spark, monkeypatch):
    one = 0x123456789ABCDEF0
    made = {"one text": one, "two texts": one ^ 1 << 41, "one text again": one}
    monkeypatch.setattr(ngram_join, "ngram_set", lambda text, hashes, n: np.array([made[text]], np.uint64))
    got = out(ngram_join.near_duplicate_groups(docs(spark, [(i, t) for i, t in enumerate(made)])), "doc_id", "component_id")
    assert got == [(0, 0), (1, 1), (2, 0)]


def test_document_rows_of_equal_or_empty_texts_are_spread(spark):
    rows = [(i, "the same text") for i in range(200)] + [(i, "") for i in range(200, 400)]
    dealt = ngram_join._deal(docs(spark, rows).withColumnRenamed("doc_id", "doc"), 5, np.empty(0, np.uint64), 8).where("body is null")
    for size in (0, 1):
        held = [r["count"] for r in dealt.where(F.col("n") == size).groupBy("part").count().collect()]
        assert sum(held) == 200 and len(held) == 8 and max(held) < 60


def test_hopeful_pairs_lose_no_link():
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(40, rng.integers(1, 30), replace=False).tolist()) for _ in range(60)]
    parts = np.array([np.bincount([x % 8 for x in s], minlength=8) for s in sets]).astype("u2")
    mark, n = rng.integers(0, 5, 60), np.array([len(s) for s in sets])
    got = set(zip(*(x.tolist() for x in ngram_join.hopeful_pairs((mark, n, parts), (mark, n, parts), 50))))
    linked = {(i, j) for i in range(60) for j in range(60) if mark[i] != mark[j] and 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert linked <= got and len(got) < 60 * 60 / 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(out(connected(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root"))
    assert got == {k: v for k, v in root.items() if k in got} and all(root[k] == k for k in set(root) - set(got))


# --- 3 -----------------------------------------------------------------------

def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    big = base[0] + rng.standard_normal((40, 16)) * 0.05
    some = base[1:4].repeat(3, 0) + rng.standard_normal((9, 16)) * 0.08
    x = np.vstack((base, big, some, base[:5]))
    rows = [(i, v.tolist(), int(i % 2 if i < 60 else 0)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, x[0].tolist(), None), (905, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit("x"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:len(x)]])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
    want = [(i, int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))] + [(i, 0, i, True) for i in range(900, 906)]
    got = out(nn_descent.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(want, key=repr)
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def brute_vectors(x, lab):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    return sorted(((i, int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))), key=repr)


def copies_of_copies(groups, each, seed):
    """Tight subgroups around one vector, all of them mutually linked."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(16)
    tops = base + rng.standard_normal((groups, 16)) * 0.06
    return np.vstack([t + rng.standard_normal((each, 16)) * 0.0005 for t in tops])


def test_near_vectors_of_tight_subgroups_are_one_component(spark):
    x = np.vstack((copies_of_copies(6, 12, 4), np.random.default_rng(5).standard_normal((30, 16))))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    want = brute_vectors(x, np.ones(len(x)))
    assert len({c for i, _, c, _ in want if i < 72}) == 1
    assert out(nn_descent.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want


def test_near_vectors_go_on_until_few_small_pairs_are_found(spark, monkeypatch):
    # one dense group whose links outnumber those of some pairs; leaves so small that a search finds few of these
    monkeypatch.setattr(nn_descent, "TABLES", 1)
    monkeypatch.setattr(nn_descent, "LEAF", 4)
    monkeypatch.setattr(nn_descent, "LEAF_MOST", 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 16))
    x = np.vstack((base, base[:40] + rng.standard_normal((40, 16)) * 0.1, base[50] + rng.standard_normal((60, 16)) * 0.04))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = out(nn_descent.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    want = brute_vectors(x, np.ones(len(x)))
    missed = [min(g[1], w[1]) / w[1] for g, w in zip(got, want) if w[1]]
    assert sum(missed) / len(missed) >= nn_descent.RECALL
    monkeypatch.setattr(nn_descent, "ROUNDS", 1)  # rounds that reach nothing: all are compared
    assert out(nn_descent.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want


# --- 4 -----------------------------------------------------------------------

def brute_lines(rows):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").encode().lower().decode()
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    res = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and d != max(held[key(x)], key=lambda i: (i is not None, i or 0)) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        res.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(res, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_line_dedup_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    pool = [f"a line long enough to count {i}" for i in range(6)] + ["short", "", "  A LINE long enough to count 0\t", "ÀÉ line long enough to count"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(40)] + EDGES
    df = docs(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert out(line_dedup.line_dedup_report(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_line_dedup_keeps_columns(spark):
    line = "this very line is in three documents"
    got = line_dedup.drop_repeated_lines(docs(spark, [(1, line + "\na"), (2, line), (3, line + "\nb"), (4, None)]))
    assert got.columns == ["doc_id", "text", "h1", "n", "sig", "words"]
    assert out(got, "doc_id", "text") == [(1, "a"), (2, ""), (3, line + "\nb"), (4, None)]
    assert line_dedup.line_dedup_report(docs(spark, [])).count() == 0


# --- 5 -----------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    words = ["the", "Straße", "don't", "naïve", "ÀÉÎ", "x1y22", "<|endoftext|>", "日本", "e\u0301a", "a\tb", "--", "İz", "ΑΣ", "µm", "\xa0x", "''s"]
    rows = [(i + 100, " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "s"]) for _ in range(rng.choice([1, 5, 300, 1500])))) for i in range(60)] + EDGES
    pieces = packing.pack_documents(docs(spark, rows).coalesce(3), BPE).collect()
    want = collections.Counter((i, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in rows)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by[p.doc_id].append(p)
        seq[p.sequence_id].append(p)
    for i in {i for i, _ in rows if i != 4}:
        got = b"".join(bytes(p.ids) for p in sorted(by[i], key=lambda p: p.start))
        assert want[i, got] == 1 and len(got) == 4 * by[i][0].doc_tokens
    pad = 0
    for some in seq.values():
        some.sort(key=lambda p: p.offset)
        ends = np.cumsum([0] + [p.length for p in some])
        assert [p.offset for p in some] == ends[:-1].tolist() and ends[-1] <= 2048
        pad += 0 if ends[-1] & (ends[-1] - 1) == 0 else 2048 - ends[-1]
    assert pad <= packing.SLACK * len(seq)
    assert packing.pack_documents(docs(spark, []), BPE).count() == 0


def test_sum_of_squares_rule_takes_the_least_change():
    rng = random.Random(1)
    p = packing.SquaresPacker(32)
    for k in range(400):
        n = rng.randint(1, 31)
        c = p.count.copy()
        cost = {}
        for level in [0, *np.flatnonzero(c[1:32]) + 1]:
            if level + n <= 32:
                after = c.copy()
                after[level] -= level > 0
                after[level + n] += 1
                cost[int(level)] = int((after[1:32] ** 2).sum())
        p.place((k, 0, b"\0" * 4 * n), n)
        after = p.count.copy()
        assert int((after[1:32] ** 2).sum()) == min(cost.values())


# --- 6 -----------------------------------------------------------------------

def test_url_filter_cases(spark):
    urls = {"http://a.org/": "org/", "http://example.org/es/x": "example.org/es/", "http://EXAMPLE.org/es": "org/", "https://x.example.org/en/12?q": "example.org/en/1",
            "http://example.org/en/2": "org/", "http://b.com/fr/": "com/fr/", "http://com/de/#x": "com/de/", "http://b.com/": None, "http://xorg/": None,
            "http://a.org?x=/": None, "no scheme": None, "": None, None: None, "http://a.org:80/": None, "ftp://.org/x": "org/"}
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    block = {"example.org/es/", "example.org/en/1", "com/de/"}
    assert got == {i: (r, "block" if r in block else "allow") for i, r in enumerate(urls.values())}
    assert url_filter.split_url("x://Ho.ST?a/b") == ("ho.st", "")


def test_url_filter_empty_repeated_and_null_rows(spark):
    ddl = "page_id bigint, url string, verdict string"
    assert url_filter.judge_urls(spark.createDataFrame([], ddl)).collect() == []
    rows = [(1, "http://a.org/", "v"), (1, "http://a.org/", "v"), (None, "http://com/de/", "v"), (None, None, "v")]
    got = [tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(rows, ddl)).collect()]
    one = (1, "a.org", "/", "org/", "allow")
    assert sorted(got, key=repr) == sorted([one, one, (None, "com", "/de/", "com/de/", "block"), (None, "", "", None, "allow")], key=repr)


def test_url_filter_many_rules_at_a_node_equal_brute_force():
    rng = random.Random(9)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["org", "a.org"]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))))
             for _ in range(3000)]
    root = url_filter.build_trie(rules)
    longest = {}
    for verdict, host, path in rules:
        if longest.get((host, path)) != "block":
            longest[host, path] = verdict
    for _ in range(300):
        host, path = rng.choice(["org", "a.org", "b.org", "x.a.org", "com"]), "/" + "".join(rng.choice("ab/c") for _ in range(rng.randint(0, 12)))
        fits = [(len(h + p), h.count("."), v, h + p) for (h, p), v in longest.items()
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits)[2:] if fits else None
        assert url_filter.longest_match(root, host, path) == best, (host, path)


# --- 7 -----------------------------------------------------------------------

def test_sentencepiece_equals_the_library():
    import sentencepiece

    model, fst = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_fst.PieceTransducer(PIECES)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "the", "\n", "▁", "é", "வ", "x", "ing", "   ", "1", ".", "<s>", "<0x41>", "\t", "er", "on", "𝒳", "ñ", "           "]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = fst.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text), text
        assert fst.decode(ids) == text.replace("▁", " ")


def test_sentencepiece_long_runs_of_spaces():
    import sentencepiece

    model, fst = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_fst.PieceTransducer(PIECES)
    for n in [*range(1, 70), 999, 1001, 100_000]:
        for text in (" " * n, "a" + " " * n + "b", "x" + " " * n + "\n"):
            assert np.frombuffer(fst.encode(text), "<u4").tolist() == model.encode(text), n
    assert max(fst.runs) <= sentencepiece_fst.LONGEST_RUN


def test_sentencepiece_documents(spark):
    df = docs(spark, EDGES + [(9, "x" * 30_000 + " y\n z")])
    enc = sentencepiece_fst.encode_documents(df, PIECES)
    assert out(sentencepiece_fst.decode_documents(enc, PIECES), "doc_id", "text") == sorted(((i, t or "") for i, t in EDGES + [(9, "x" * 30_000 + " y\n z")]), key=repr)
    assert sentencepiece_fst.sentencepiece_report(df, PIECES).where("round_trip").count() == len(EDGES) + 1
    assert sentencepiece_fst.sentencepiece_report(docs(spark, []), PIECES).count() == 0


# --- 8 -----------------------------------------------------------------------

def test_suffix_order():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_suffix(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    starts = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    res = []
    for (d, _), b in zip(rows, texts):
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        res.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return sorted(res, key=repr)


@pytest.mark.parametrize("many", [1000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (38, 40, 41, 60, 120)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 50)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += EDGES + [(100, "a" * 300), (101, "ab" * 100), (102, "abcdefg" * 30), (103, shared[4]), (103, shared[4])]
    got = suffix_dedup.suffix_dedup_report(docs(spark, rows), length=40, gram=25)
    assert out(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(rows, 40)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup_report(docs(spark, [])).count() == 0
    got = suffix_dedup.suffix_dedup_report(docs(spark, [(1, "x" * 399), (2, "y" * 400), (3, "z" * 401), (4, None)]))
    assert out(got, "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 401), (4, 0)]


def brute_shared(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    have = collections.defaultdict(set)
    for row, w in zip(rows, words):
        for i in range(len(w) - n + 1):
            have[tuple(w[i:i + n])].add(row)
    return sorted(((d, int(any(len(have[tuple(w[i:i + n])]) > 1 for i in range(len(w) - n + 1)))) for (d, _), w in zip(rows, words)), key=repr)


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_shares_passage_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(88)
    text = lambda n: "".join(rng.choice(["a", "bé", "c\u00a0d", "e."]) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))
    shared = [text(n) for n in (50, 51, 52, 60, 75)]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(shared + [text(55)] * 5) + text(rng.randint(0, 60)).strip()) for i in range(40)]
    rows += EDGES + [(100, "a " * 200), (101, "a b " * 40), (102, text(80) * 3), (None, shared[4]), (103, "x" * 90 + " " + shared[1])]
    once, other = text(70), text(50)
    rows += [(104, once + "q " + once), (105, "r " + " ".join(once.split()[8:60])), (106, "a b " * 30), (107, other), (107, other + "z"), (108, other + "z")]
    got = suffix_dedup.suffix_dedup_report(docs(spark, rows))
    assert out(got, "doc_id", "shares_passage") == brute_shared(rows, suffix_dedup.WORDS)


def test_passages_of_51_short_words_are_told_and_stay(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    got = suffix_dedup.suffix_dedup_report(docs(spark, [(1, "one " + passage), (2, passage + "\ntwo"), (3, passage[:-4] + " three"), (4, "x " * 99)]))
    assert out(got, "doc_id", "n_removed", "shares_passage") == [(1, 0, 1), (2, 0, 1), (3, 0, 0), (4, 0, 0)]


# --- 9 -----------------------------------------------------------------------

def toxic_rows(n=400):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    bad = ["wretchfool", "grumblepig", "kackzwerg"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows_and_gapped_words(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    df = docs(spark, rows + [(9000, "enare a wretchxfool"), (9001, "o g.r.u.m.b.l.e.p.i.g o"), (9002, ""), (9003, None), (None, "enare")])
    got = {r.doc_id: r for r in toxicity.toxicity_report(df, lab).collect()}
    truth = dict(labels)
    for r in (r for r in got.values() if r.doc_id in truth):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert got[9000].predicted == got[9001].predicted == 1
    assert got[9002].predicted == got[9003].predicted == 0 and got[9002].score == got[9003].score and got[None].held_out
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_both_classes(spark):
    lab = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert out(toxicity.toxicity_report(docs(spark, [(1, "a text"), (2, None)]), lab), "score", "predicted") == [(1 / (1 + np.e), 0)] * 2
    assert toxicity.toxicity_report(docs(spark, []), lab.limit(0)).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)], [(1, 1), (2, 0)]])
def test_nothing_to_learn_from_rejects_nothing(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    df = docs(spark, [(1, "a text"), (2, "other words"), (3, None), (None, "more words")])
    assert out(toxicity.drop_toxic(df, lab), "doc_id", "text") == out(df, "doc_id", "text")
    assert out(toxicity.toxicity_report(df, lab), "predicted") == [(0,)] * 4


# --- 10 ----------------------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((200, 8)), 1)
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [1.0, None]), (400, [float("inf")] * 8), (None, x[0].tolist()), (450, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    q = np.floor(256 * x).astype(int)
    q = np.vstack((q, np.floor(256 * np.array([2.0, 1.0] + [0] * 6)).astype(int)))
    ids = [*range(200), 450]
    want = []
    for i, a in zip(ids, q):
        if i % 50 == 0:
            best = sorted((-int(a @ b), j) for j, b in zip(ids, q) if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert out(topk_search.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk_search.top_k(df.limit(0)).count() == 0
    assert topk_search.top_k(spark.createDataFrame(rows[:3], df.select("vec_id", "embedding").schema)).count() == 2


def test_top_k_of_large_components_equals_the_sql(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 6)) * rng.choice([1.0, 300.0, 30_000.0, 60_000.0], (120, 1))
    x[100], x[101], x[102] = 90_000.0, 90_001.0, 32_768.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = [tuple(int(c) for c in r) for r in con.sql(f"SELECT query_id, rank, vec_id, score FROM ({topk_search.TOP_SQL})").fetchall()]
    assert out(topk_search.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_top_k_beyond_double_precision_and_64_bits(spark):
    # products of 2**96, whose rounding hides the third component, cancel
    rows = [(0, [2.0 ** 40, -2.0 ** 40, 1.0])] + [(i, [2.0 ** 40, 2.0 ** 40, float(i % 7)]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = out(topk_search.top_k(df), "rank", "vec_id", "score")
    best = sorted((-(256 * 256 * (i % 7)), i) for i in range(1, 30))[:5]
    assert got == [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="does not fit a bigint"):
        topk_search.top_k(spark.createDataFrame([(0, [2.0 ** 40]), (1, [2.0 ** 40])], df.schema)).collect()
    with pytest.raises(Exception, match="does not fit a bigint"):
        topk_search.top_k(spark.createDataFrame([(0, [2.0 ** 40]), (1, [-2.0 ** 40])], df.schema)).collect()


def test_toxicity_score_of_a_half_is_toxic(spark, monkeypatch):
    model = toxicity.no_evidence()
    model["weights"][-1] = 0.0
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: model)
    df, lab = docs(spark, [(1, "a text"), (2, None)]), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert out(toxicity.toxicity_report(df, lab), "score", "predicted") == [(0.5, 1)] * 2
    assert toxicity.drop_toxic(df, lab).count() == 0


def test_ngram_cells_round_trip(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sig = rng.integers(-2 ** 63, 2 ** 63 - 1, 40, dtype=np.int64)[rng.integers(0, 40, 5000)]
    toks, rank = rng.integers(0, 2 ** 62, 5000), rng.integers(0, 20, 5000).astype("u1")
    whole = sorted(zip(sig.tolist(), toks.tolist(), rank.tolist()))
    for ranges in (1, 7, 64, 1000):
        cells = list(ngram_join.packed(sig, toks, rank, ranges))
        assert len(cells) == len({c for c, _ in cells}) and sorted(zip(*(c.tolist() for c in ngram_join.unpacked([b for _, b in cells])))) == whole
    monkeypatch.setattr(ngram_join, "FAN", 2)  # three further passes
    parts = spark.createDataFrame([(c, bytearray(b)) for k in range(4) for c, b in ngram_join.packed(sig[k::4], toks[k::4], rank[k::4], 2)],
                                  "cell int, body binary")
    got = ngram_join._shares_of_sets(parts, 13).collect()
    assert len(got) == len(set(sig.tolist())) and sorted((r.sig, t, k) for r in got for t, k in zip(
        np.frombuffer(r.toks, "<i8").tolist(), np.frombuffer(r.ranks, "u1").tolist())) == whole
    assert all(r.live == len(r.ranks) for r in got)


def test_packing_ids_equal_the_library():
    words = packing.WordIds(BPE)
    texts = [None, "", " ", "\n\n", "It's <|endoftext|>x né ß İ ı ﬁ 你好 a b\tc\r\nd", "a" * 5000, "É'LL 12,5%% ***", "x y  z",
             "<|startoftext|>", " lead and trail ", "don't WE'VE o'clock 'd ''s", "mañana " * 300]
    rng = random.Random(5)
    texts += ["".join(rng.choice("aé'sß1 .\nÑ<|×÷x") for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [words.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most, piece in ((packing.CACHE, 400), (3, 7)):  # small caches age in the middle of a slice
        words.odd, words.part = packing.Aged(words._odd, most), packing.Aged(words._part, most)
        got = [x for a in range(0, len(texts), piece) for x in words.encode(pa.array(texts[a:a + piece], pa.string()))]
        assert [g.tolist() for g in got] == want
    assert list(words.encode(pa.array([], pa.string()))) == []


def test_windows_hold_all_neighbours_of_a_sentence():
    assert toxicity.windows("") == [] and toxicity.windows(" \n. ") == []
    assert toxicity.windows("One. Two") == ["one", "two"]
    assert toxicity.windows("a b c d e f g! h.i") == ["a b c d", "d e f g", "h.i"]
    for n in range(2, 30):
        words = [str(i) for i in range(n)]
        got = toxicity.windows(" ".join(words))
        assert all(any(f" {a} {b} " in f" {w} " for w in got) for a, b in zip(words, words[1:], strict=False))


def test_window_margins_in_parts_and_on_long_texts():
    rng = np.random.default_rng(1)
    theta = rng.normal(size=toxicity.CLASSES ** 3)
    texts = ["", "one", "some more words here. And more of them", " ".join(f"w{i}x" for i in range(30_000))]
    want = {i: toxicity.margins(toxicity.windows(t), theta, 0.5) for i, t in enumerate(texts) if t}
    for most in (1, 3, 20_000):
        got: dict[int, list] = {}
        for i, mine, m in toxicity.window_margins(texts[:3] if most < 9 else texts, theta, 0.5, most):
            assert len(mine) == len(m) <= most
            got.setdefault(i, []).extend(m)
        assert all(np.allclose(got[i], want[i]) for i in got) and set(got) == set(list(want)[:len(got)])


def test_toxicity_machine_learns_from_windows_across_word_borders(spark):
    rows = [(i, f"plain words {'dirty rat' if i % 2 else 'rat and dirty'} end {i % 7}") for i in range(200)]
    bound = spark.createDataFrame([(i, i % 2, t) for i, t in rows], "doc_id bigint, toxic int, text string")
    theta, bias = toxicity.fit_words(["dirty"], ["plain", "words"])
    a, b, both = toxicity.fit_windows(bound, theta, bias)
    for machine in (a, b, both):
        near, apart = toxicity.margins(["words dirty rat end", "words rat and dirty"], *machine)
        assert near > apart
    empty = toxicity.fit_windows(bound.limit(0), theta, bias)
    assert all(not t.any() and c == toxicity.NONE for t, c in empty)


def test_toxicity_of_repeated_rows(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels + labels, "doc_id bigint, toxic int")
    once = out(toxicity.toxicity_report(docs(spark, rows), lab), "doc_id", "score")
    twice = out(toxicity.toxicity_report(docs(spark, rows + rows), lab), "doc_id", "score")
    assert sorted(twice) == sorted(once + once)
