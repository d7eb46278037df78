"""Toxicity: decoding of disguised words, the corpus model, held-out labels, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    costs = toxicity.language_model(docs)
    return docs, labels, costs, *toxicity.train(docs, labels, costs)


def test_language_model_counts_every_text(spark):
    docs = spark.createDataFrame([("ab a",), (None,), ("",), ("AB",), ("é1",)], "text string").repartition(3)
    rows = {r["code"]: r["n"] for r in toxicity.trigram_rows(docs).collect()}
    code = lambda *signs: (signs[0] * toxicity.SIGNS + signs[1]) * toxicity.SIGNS + signs[2]
    assert rows[code(0, 1, 2)] == 2 and rows[code(1, 2, 0)] == 2 and rows[code(0, 1, 0)] == 1
    assert toxicity.trigram_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, word", [
    ("the 1d10t was", "idiot"), ("an idiooooot ere", "idiot"), ("$tup1d", "stupid"), ("m0r0n!", "moron"), ("l-o-s-e-r", "loser"),
    ("tr@$h", "trash"), ("clooown", "clown"), ("p.a.t.h.e.t.i.c", "pathetic"), ("disgu5ting", "disgusting"),
])
def test_restores_disguised_words(fitted, text, word):
    assert word in toxicity.Restorer(fitted[2]).document(text)[0]


def test_restores_spaced_words(fitted):
    assert "idiot" in toxicity.Restorer(fitted[2]).document("the i d i o t was")[1]


def test_viterbi_equals_all_paths(fitted):
    from itertools import product

    costs = fitted[2]
    for token in ("1d10t", "aa4a", "s-0-s", "b00k!", "l33t", "x"):
        best = None
        for way in product(*toxicity.lattice(token)):
            letters = [c for c, _ in way if c]
            signs = [0, 0, *(toxicity.CODE.get(c, toxicity.OTHER) for c in letters), 0]
            cost = sum(k for _, k in way) + sum(costs[a, b, c] for a, b, c in zip(signs, signs[1:], signs[2:], strict=False))
            best = min(best or (np.inf, ""), (cost, "".join(letters)))
        assert toxicity.restore(token, costs) == best[1]


def test_held_out_labels(fitted):
    docs, labels, costs, prior, weights = fitted
    rows = toxicity.score(docs, costs, prior, weights).join(labels, "doc_id").where(toxicity.held_out(labels["doc_id"])).collect()
    right = [(r["score"] >= 0.3) == (r["toxic"] == 1) for r in rows]
    assert sum(right) >= 0.9 * len(right)
    caught = [r["score"] >= 0.3 for r in rows if r["toxic"] == 1]
    assert sum(caught) >= 0.6 * len(caught)


def test_odd_rows(spark, fitted):
    _, _, costs, prior, weights = fitted
    rows = [(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "a " * 50_000, "x"), (3, "1" * 50_000, "x"), (4, "the idiot", "x"), (4, "the idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = toxicity.score(docs, costs, prior, weights).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"], 9) for r in got if not r["text"]} == {round(1 / (1 + np.exp(-prior)), 9)}
    assert all(r["score"] >= 0.3 for r in got if r["text"] and "idiot" in r["text"])
    none = spark.createDataFrame([], "doc_id bigint, toxic bigint")
    assert toxicity.judged(docs, none).count() == len(rows)
    assert toxicity.judged(docs.limit(0), none).count() == 0


FILLER = "ana bere colo dima enta fure golo hima iste jaro kelo lumo".split()


def labelled(spark, toxic_texts, clean_texts):
    """Documents and labels, none of them held out."""
    ids = [r["id"] for r in spark.range(4 * (len(toxic_texts) + len(clean_texts))).where(~toxicity.held_out(F.col("id"))).collect()]
    rows = [(t, 1) for t in toxic_texts] + [(t, 0) for t in clean_texts]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in zip(ids, rows, strict=False)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in zip(ids, rows, strict=False)], "doc_id bigint, toxic bigint")
    return docs, labels


def prose(i):
    return " ".join(FILLER[(i * k) % 12] for k in (1, 5, 7, 11, 3)) + f" nr{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}"


def test_rare_toxic_words_count_and_copies_do_not(spark, fitted):
    words = [a + b for a in ("grobu", "vexil", "quonk", "zarfa", "plimo", "drusk", "wombl", "fleeg", "snorq", "jibbo") for b in
             ("tan", "mer", "sil", "dop", "kuv", "rix")]
    toxic = [f"{prose(i)} {words[i // 10]} {prose(i + 7)}" for i in range(600)]
    copies = ["ana copiedword bere"] * 40
    docs, labels = labelled(spark, toxic + copies, [prose(i) + f" c{i}" for i in range(4_800)])
    _, weights = toxicity.train(docs, labels, fitted[2])
    # Each word is in 10 of 601 toxic texts, under two in a hundred.
    assert all(w in weights for w in words) and "copiedword" not in weights


@pytest.mark.parametrize("text, word", [
    ("a stuupid b", "stupid"), ("iidiot", "idiot"), ("st.up.id", "stupid"), ("i-diot", "idiot"), ("lo-se-r", "loser"), ("stu_pid", "stupid"),
    ("l0$3", "lose"), ("1d107", "idiot"),
])
def test_restores_partly_disguised_words(fitted, text, word):
    assert word in toxicity.Restorer(fitted[2]).document(text)[0]


def test_beginnings_in_spaced_stretches(fitted):
    spaced = " ".join("pathetically")
    assert toxicity.score_text(f"the {spaced} was", toxicity.Restorer(fitted[2]), -2.0, {"pathe*": 4.0}) > 0.5


def test_no_evidence_is_not_toxic_under_a_toxic_half(spark, fitted):
    costs = fitted[2]
    docs, labels = labelled(spark, [f"{prose(i)} grobutan" for i in range(1_000)], [prose(i) + " c" for i in range(1_000)])
    rows = spark.createDataFrame([(1, ""), (2, "ana bere colo"), (3, None), (4, "ana grobutan")], "doc_id bigint, text string")
    for some in (labels, labels.where("toxic = 1")):
        prior, weights = toxicity.train(docs, some, costs)
        scores = {r["doc_id"]: r["score"] for r in toxicity.score(rows, costs, prior, weights).collect()}
        assert all(scores[i] < 0.3 for i in (1, 2, 3))
        assert not weights or scores[4] >= 0.3


def test_a_token_is_looked_through_once_for_all_texts(monkeypatch):
    seen = []
    one = toxicity.strongest_of
    monkeypatch.setattr(toxicity, "strongest_of", lambda word, weights: seen.append(word) or one(word, weights))
    weights = {"bad": 4.0, "wors*": 3.0}
    restorer = toxicity.Restorer(np.ones((toxicity.SIGNS,) * 3))
    assert [toxicity.strongest(t, restorer, weights) for t in ("a bad-worse one", "one bad-worse a bad", "a one", "")] == [
        [4.0, 3.0], [4.0, 3.0], [], []]
    assert sorted(seen) == sorted(["a", "bad", "worse", "one", "bad", *toxicity.WORD.findall(toxicity.restore("bad-worse", restorer.costs))])
    assert toxicity.strongest("a one", restorer, {"one": 5.0}) == [5.0]
