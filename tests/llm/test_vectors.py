"""Embedding near-dedup and top-k search against brute force."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import spherical, topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def planted(seed, n, dims, cosine=0.956):
    """Random vectors, each fifth with a partner just above the threshold, and one group of near copies."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n - 1, 5):
        away = draw.normal(size=dims)
        away -= away @ x[i] * x[i]
        x[i + 1] = cosine * x[i] + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    x[n // 2:n // 2 + n // 6] = x[0] + draw.normal(size=(n // 6, dims)) * 0.01
    return x.astype(np.float32)


def links(rows, cosine):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    return {(i, j) for i, a in good for j, b in good
            if i != j and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine}


@pytest.mark.parametrize("dims", [3, 8, 64])
def test_all_links_over_cells(spark, monkeypatch, dims):
    monkeypatch.setattr(spherical, "PER_CELL", 60)
    monkeypatch.setattr(spherical, "BLOCK", 50)
    rows = list(enumerate(planted(2, 600, dims).tolist()))
    want = links(rows, 0.95)
    got = {r["vec_id"]: r for r in spherical.near_duplicates(frame(spark, rows)).collect()}
    degree = {i: sum(1 for a, _ in want if a == i) for i, _ in rows}
    assert {i: r["n_links"] for i, r in got.items()} == degree
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_dedup_of_odd_rows(spark):
    v = [0.6, 0.8, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [NAN, 1.0, 0.0]), (5, [INF, 1.0, 0.0]), (6, [None, 1.0, 0.0]),
            (10, v), (11, v), (12, [1.2, 1.6, 0.0]), (13, [0.6, 0.8]), (14, [-0.6, -0.8, -0.0]), (15, [0.0, 0.0, 1.0]), (16, [-0.0, 0.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in spherical.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 13, 14):
        assert got[i] == (0, i, True)
    assert got[10] == (2, 10, True) and got[11] == (2, 10, False) and got[12] == (2, 10, False)
    assert got[15] == (1, 15, True) and got[16] == (1, 15, False)
    assert spherical.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    repeated = spherical.near_duplicates(frame(spark, [(1, v), (1, v), (None, v)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in repeated) == [(0, 0), (1, 1), (1, 1)]


def test_sample_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(spherical, "PER_CELL", 25)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = {r["vec_id"]: r["n_links"] for r in spherical.near_duplicates(table).collect()}
    assert sum(got.values()) == len(links(rows, 0.95))


def best(rows, k, every):
    q = lambda v: [max(-2**63, min(2**63 - 1, math.floor(256 * c))) for c in v]
    good = {i: q(v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, a in good.items():
        if i % every == 0:
            held = lambda b, a=a: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
            scored = sorted((-held(b), j) for j, b in good.items() if j != i)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 1024), (40, 3)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    draw = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(300, 6)).round(1))]
    rows += [(400, None), (401, [NAN] * 6), (402, [INF] + [0.0] * 5), (403, [None, 1.0]), (404, []), (410, [0.0] * 6), (420, [3e38] * 6),
             (430, [1.0, 2.0]), (440, [-3.0, 0.5] * 4), (None, [1.0] * 6)]
    got = topk.top_k(frame(spark, rows), 5, F.col("vec_id") % 10 == 0).collect()
    want = best([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 5, 10)
    assert sorted(tuple(r) for r in got) == want


def test_top_k_of_few(spark):
    got = topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), 5, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert topk.top_k(frame(spark, [(0, [1.0])]).limit(0), 5, F.lit(True)).count() == 0


def test_top_k_of_repeated_ids(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, -1.0])]
    rows += [(7, [0.5 + i / 8, -1.0]) for i in range(12)]
    table = frame(spark, rows)
    for blocks in ((8192, 1024), (3, 1)):
        monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
        monkeypatch.setattr(topk, "QUERIES", blocks[1])
        got = sorted(tuple(r) for r in topk.top_k(table, 5, F.col("vec_id") % 50 == 0).collect())
        want = duckdb.sql(topk.sql(5, 50).replace("FROM embeddings", "FROM repeated"), connection=over(rows)).fetchall()
        assert got == sorted(want)
        assert (0, 1, 1, 196608) in got


def test_top_k_by_row_lists_the_other_rows_of_an_id(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.25, 0.0]), (3, [0.0, 0.0]), (50, [0.0, 0.0]), (50, None)]
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None]
    want = []
    for at, (query, v) in enumerate(kept):
        scored = [(-sum(a * b for a, b in zip(v, w)), other) for n, (other, w) in enumerate(kept) if n != at]
        want += [(query, rank, other, -score) for rank, (score, other) in enumerate(sorted(scored)[:5], 1) if query % 50 == 0]
    for blocks in ((8192, 1024), (2, 1)):
        monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
        monkeypatch.setattr(topk, "QUERIES", blocks[1])
        got = topk.top_k(frame(spark, rows), 5, F.col("vec_id") % 50 == 0, by_row=True).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def over(rows):
    base = duckdb.connect()
    base.execute("CREATE TABLE repeated (vec_id BIGINT, embedding FLOAT[])")
    base.executemany("INSERT INTO repeated VALUES (?, ?)", rows)
    return base
