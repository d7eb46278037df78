"""The n-gram join against all pairs, and its signatures' promise."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import partenum

SAMPLE = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows):
    """Sizes and components of ``(doc_id, text)`` by all pairs; texts of one id are tied."""
    sets = [(i, shingles(t)) for i, t in rows]
    low = list(range(len(sets)))
    changed = True
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1]
             and (sets[a][0] == sets[b][0] or 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1]))]
    comp = [i for i, _ in sets]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    del low
    return sorted((i, len(s), c) for (i, s), c in zip(sets, comp, strict=True))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id bigint, text string, rep string, n int")
    got = sorted(tuple(r) for r in partenum.similar_documents(docs.repartition(3)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == by_hand(rows)


def test_sample(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()])


def test_odd_rows_and_a_large_group(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(55)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  Two"), (6, "one two three"), (7, "Ünï Ünï"), (8, "üNï Ünï")]
    for i in range(100, 180):  # near copies of one text
        text = list(passage)
        text[draw.randrange(55)] = word()
        rows.append((i, " ".join(text)))
    for i in range(200, 240):  # one passage in different texts
        rows.append((i, " ".join([word() for _ in range(draw.randrange(1, 60))] + passage + [word() for _ in range(draw.randrange(60))])))
    rows += [(i + 1000, t) for i, t in rows[20:30]]  # copies
    rows += [(300, " ".join(word() for _ in range(30_000)))]
    rows += [(301, rows[-1][1] + " end")]
    chain = [word() for _ in range(100)]
    for i in range(400, 420):  # each like the next only
        chain = chain[2:] + [word(), word()]
        rows.append((i, " ".join(chain)))
    check(spark, rows)


def test_one_id_with_several_texts(spark):
    draw = random.Random(9)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e = (text(n) for n in (60, 70, 25, 40, 3))
    start = lambda t: t.rsplit(" ", 2)[0]
    rows = [(1, a), (1, b), (2, start(a)), (3, start(b)), (4, text(30)), (1, ""), (6, None)]
    rows += [(9, c), (8, c), (8, d), (7, start(d)), (7, start(d)), (10, e), (10, text(12)), (5, e)]  # 5 to 10 by shared ids and texts
    check(spark, rows)


def test_parts_of_every_band():
    """The chance of a miss stays below the bound over all unions of a band."""
    for band in range(14):
        p = partenum.band_parts(band)
        assert p or band < 5
        for u in np.linspace(2**band, 2 ** (band + 2) / 1.75, 40) if p else []:
            assert (1 - (math.exp(-0.25 * u / p) - math.exp(-u / p))) ** p <= partenum.MISS


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert partenum.similar_documents(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 16, 20, 31, 40, 64, 100, 127, 128, 300, 1000, 5000])
def test_similar_sets_share_a_signature(size):
    draw = np.random.default_rng(size)
    for _ in range(60 if size < 1000 else 10):
        a = draw.integers(0, 2**63, size, dtype=np.uint64)
        for added in (0, size // 3, size // 7):
            other = draw.integers(0, 2**63, added, dtype=np.uint64)
            keep = size - next(d for d in range(size, -1, -1) if 100 * (size - d) >= 75 * (size + added))if 100 * size >= 75 * (size + added) else size
            b = np.concatenate([a[:keep], other])
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                assert set(partenum.signatures(x)) & set(partenum.signatures(y))


def test_a_slice_of_less_than_five_words():
    texts = [b"one  two", None, b" ", b"Three"]
    assert [len(s) for s in partenum.sets_of(pa.array(texts, pa.binary()))] == [1, 0, 0, 1]
    alone = [partenum.sets_of(pa.array([t], pa.binary()))[0].tolist() for t in texts]
    long = partenum.sets_of(pa.array([*texts, b"a b c d e f"], pa.binary()))
    assert [s.tolist() for s in long[:4]] == alone and len(long[4]) == 2
