"""The pipeline's stages and the registered queries, on the smallest tables."""

import re

import duckdb
import pytest
from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from vicinal.llm import language_id, mixing, registry


def test_stages(spark, documents, sf, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5
    docs, before = documents, None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == documents.columns
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
    # what is left has no copies, and every text that went has a like one left, or no letters
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    assert len({normal(t) for t in texts.values()}) == len(texts)
    kept = [shingles(t) for t in texts.values()]
    for r in documents.collect():
        if r.doc_id not in texts and language_id._has_letter(r.text):
            mine = shingles(r.text)
            assert max(len(mine & k) / len(mine | k) for k in kept) > 0.6


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_run_is_in_mixed_order(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    places = [r.position for r in rows]
    assert len(rows) > 0 and places == sorted(places)
    df = spark.createDataFrame([(r.doc_id, r.source) for r in rows], "doc_id long, source string")
    assert {(r.doc_id, r.position) for r in rows} == {(r.doc_id, r.position) for r in mixing.mix(df).collect()}


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(k.startswith(f"op{n}_") for k in registry.QUERIES) == 1


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_gives_the_same(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))
