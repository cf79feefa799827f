"""Registered training-data queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_SMALL
from test_operators_small import brute_groups, brute_lines
from ventanilla.llm import line_dedup, pii, queries, toxicity
from ventanilla.llm.common import read_table

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_operator_has_one_query():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    res = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(res.columns, res.fetchall())


def test_pipeline_stages_against_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity_report(docs, read_table(spark, SF_SMALL, "labels")).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {d: t for d, t in rows.items() if not scored[d]}
    want = {d: sha for d, _, _, sha in brute_lines(list(rows.items()))}
    step = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(step).collect()}
    import hashlib
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows.items()} == want
    rows = {d: rows[d] for d, n, c in brute_groups(list(rows.items())) if n == 0 or c == d}
    rows = {d: pii.redact(t, pii.find_spans(t)) for d, t in rows.items()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got: dict[int, list] = {}
    for p in corpus_pipeline.run(spark, SF_SMALL).collect():
        got.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in got.items()} == {
        d: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for d, t in rows.items()}


def test_stages_keep_the_columns_of_documents(spark):
    docs = read_table(spark, SF_SMALL, "documents").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.dtypes == read_table(spark, SF_SMALL, "documents").dtypes
