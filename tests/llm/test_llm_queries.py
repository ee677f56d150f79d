"""The registered queries against SQL or brute force, and the pipeline, on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tools.check_queries import compare, connect
from vacantia.llm import queries
from vacantia.llm.common import table

FOLDER = os.environ.get("VACANTIA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], con) == ""


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5


def test_token_query_equals_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_token_files"](spark, FOLDER).collect()}
    start = 0
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_leak_query_finds_all_whole_items(spark):
    fold = lambda t: " ".join((t or "").lower().split())
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    items = [(i, fold(t)) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    want = {(d, i) for d, text in docs for i, item in items if item in fold(text)}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.QUERIES["op3_edit_matches"](spark, FOLDER).collect()}
    assert want and {k for k, edits in got.items() if edits == 0} == want


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame, stages = docs, dict(corpus_pipeline.STAGES)
    judged = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op7_tokenizer_fertility"](spark, FOLDER).collect()}
    frame = stages["quality_rules"](spark, frame, FOLDER)
    assert frame.columns == docs.columns
    left = {k: v for k, v in left.items() if judged[k]}
    assert {r["doc_id"] for r in frame.collect()} == set(left) and len(left) > 0.8 * len(judged)
    frame = stages["near_duplicates"](spark, frame, FOLDER)
    seen = {}
    for k in sorted(left):
        seen.setdefault(left[k], k)
    stays = {r["doc_id"] for r in frame.collect()}
    assert frame.columns == docs.columns and stays <= set(seen.values()) and len(stays) > 0.8 * len(seen)
    leaks = {r["doc_id"] for r in queries.QUERIES["op3_edit_matches"](spark, FOLDER).collect()}
    frame = stages["benchmark_decontamination"](spark, frame, FOLDER)
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == stays - leaks
    frame = stages["source_mix"](spark, frame, FOLDER)
    mixed = sorted(r["doc_id"] for r in frame.collect())
    assert frame.columns == docs.columns and set(mixed) <= stays - leaks and max(map(mixed.count, mixed)) <= 3
    out = stages["token_output"](spark, frame, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == mixed
