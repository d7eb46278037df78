"""Mixing: targets, taken words, positions and odd rows (the sample is compared with SQL in tests/test_oracle.py)."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.curriculum import Mix, assign, plan, position


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing what stands above a cap until nothing does."""
    total, targets, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if total * weights[s] / w > most * sizes[s]}
        if not over:
            return targets | {s: total * weights[s] / w for s in free}
        for s in over:
            targets[s] = most * sizes[s]
            total -= targets[s]
        free -= over
    return targets


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 40)), draw.choice(["hot"] * 6 + ["b", "c", "é", None, ""]), "clash") for i in range(400)]
    rows += [(1000, None, "hot", "clash"), (1001, "\x1c a b", "z", "clash"), (7, "again and again", "b", "clash"), (None, "no id", "b", "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string").repartition(4)


def test_targets_and_taken(docs):
    rows = plan(docs).collect()
    assert len(rows) == docs.count()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for s in order:
        mine = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert rows and sorted(map(str, plan(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_order_of_the_mix(docs):
    rows = assign(docs).collect()
    assert assign(docs).columns == [*docs.columns, "pass", "position"]
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    taken = {(r["doc_id"], r["text"]): r["taken"] for r in plan(docs).collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} == {k for k, n in taken.items() if n}


@pytest.mark.parametrize("factors", [(1.0, 1.0), (1.5, 1.0, 0.5), (0.0, 2.0), (2.0, 0.0), (0.5, 3.0, 0.0, 1.0)])
def test_position_inverts_the_integral(spark, factors):
    steps = 20_000
    def height(t):
        x = min(t, 1 - 1e-12) * (len(factors) - 1)
        i = int(x)
        return factors[i] + (factors[i + 1] - factors[i]) * (x - i)
    area, total = [0.0], sum(height((i + 0.5) / steps) for i in range(steps))
    for i in range(steps):
        area.append(area[-1] + height((i + 0.5) / steps) / total)
    shares = spark.createDataFrame([(x / 20,) for x in range(20)], "share double")
    for r in shares.withColumn("t", position(F.col("share"), factors)).collect():
        assert abs(area[round(r["t"] * steps)] - r["share"]) < 1e-3


def test_empty_and_wordless(spark):
    schema = "doc_id bigint, text string, source string"
    assert plan(spark.createDataFrame([], schema)).count() == 0
    rows = plan(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [(r["taken"], r["target"]) for r in rows] == [(0, 0.0), (0, 0.0)]
    assert assign(spark.createDataFrame([(1, "", "a")], schema)).count() == 0
    assert plan(spark.createDataFrame([(1, "a b", "a")], schema), Mix()).first()["taken"] == 3
