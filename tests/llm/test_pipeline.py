"""The pipeline's stages on a small table, against brute force."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from millrace.llm import toxicity
from tests.llm.test_partenum import by_hand

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_columns(steps):
    assert all(columns == steps[0][0] for columns, _ in steps[:-1])


def test_toxic_documents_go(spark, steps):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.judged(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in steps[1][1]} == {i for i, s in scores.items() if s < corpus_pipeline.TOXIC_FROM}


def test_one_of_each_group_stays(steps):
    want = {i for i, _, c in by_hand([(r["doc_id"], r["text"]) for r in steps[1][1]]) if i == c}
    assert sorted(r["doc_id"] for r in steps[2][1]) == sorted(want)


def test_secrets_go_and_documents_stay(steps):
    before, after = ({r["doc_id"]: r for r in steps[i][1]} for i in (2, 3))
    assert set(before) == set(after)
    for i, r in after.items():
        text = re.sub(r'(?<=password=)[0-9a-f]{18}|AKIA[A-Z2-7]{16}|(?<=token = ")[0-9a-f]{40}', "[SECRET]", before[i]["text"], flags=re.I)
        assert r["text"] == text and r["n_chars"] == len(text)


def test_mix_repeats_and_encodes(steps):
    assert {r["doc_id"] for r in steps[4][1]} <= {r["doc_id"] for r in steps[3][1]}
    assert sorted(r["doc_id"] for r in steps[4][1]) == sorted(r["doc_id"] for r in steps[5][1])
    assert all(r["n_tokens"] == len(r["ids"]) for r in steps[5][1])


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(steps[5][1])
