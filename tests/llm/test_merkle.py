"""The Merkle manifest against trees built in one go."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, digest string, index int, proof string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i // 16 * 16
        yield level[first:i], level[i + 1:first + 16]
        i //= 16


def brute(rows):
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = climbed([leaf(*r) for r in by[s]])
    top = climbed([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = (r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:])
            folded = leaf(*now)
            for left, right in steps:
                folded = H("".join([*left, folded, *right]))
            root = top[-1][0]
            out.append((r[0], s, leaf(*r), trees[s][-1][0], root, H("".join("".join(a + b) for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


ODD = [(None, "Null id", "en", "web", 7), (None, "Null id", "en", "web", 7), (3, None, None, None, None), (4, "", "", "", 0), (5, "É and A", "fr", "é", 7),
       (6, "Twice", "en", "web", 5), (6, "Twice", "en", "web", 5), (6, "Other", "en", "web", 5), (9, "Long " * 50_000, "en", "lone", 250_000)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_proofs(spark, levels):
    rows = [*ODD, *((100 + i, f"Text {i % 40}", "en", f"s{i % 3}" if i % 3 else "web", i) for i in range(640))]
    got = merkle.checked(merkle.proofs(merkle.tampered(frame(spark, rows)), levels)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert 0 < sum(not r["verified"] for r in got) < len(got) / 3


def test_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"source {i}", i) for i in range(300)]
    got = merkle.checked(merkle.proofs(merkle.tampered(frame(spark, rows)), 1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "web", 1)], [(1, "A", "en", None, 1), (2, "B", "en", None, 1)]])
def test_small_tables(spark, rows):
    got = merkle.checked(merkle.proofs(merkle.tampered(frame(spark, rows)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_sweeps():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(200)]
    nodes = merkle.sweep_up(leaves, merkle.rounds(200, 3))
    assert [[d.hex() for d in level] for level in nodes] == climbed([d.hex() for d in leaves])
    proofs = merkle.sweep_down(nodes, b"")
    assert all(merkle.fold(d, p) == nodes[-1][0] for d, p in zip(leaves, proofs, strict=True))
    assert merkle.fold(leaves[0], proofs[1]) != nodes[-1][0]


def test_a_change_of_any_field_shows(spark):
    rows = [(1, "ab", "c", "d", 2), (1, "b", "ca", "d", 2), (1, "ab", "", "cd", 2), (1, "ab", None, "cd", 2), (12, "ab", "c", "d", 2)]
    assert merkle.leaves(frame(spark, rows)).select(F.countDistinct("digest")).first()[0] == len(rows)
