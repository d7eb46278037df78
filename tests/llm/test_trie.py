"""The prefix trie against prefixes written out."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, part int, n int, own string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], SCHEMA).repartition(3)


def sequences(rows, rebuild=True):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t for _, _, t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members: dict[tuple, list] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(trie_words(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += children[p] == 0
    rows = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        rows.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def trie_words(text):
    return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]


def made(seed, n, hot=0.4):
    draw = random.Random(seed)
    texts = ["a", "a b", "", None, "c\td\ne", "hé è", "x" * 3000]
    rows = []
    for c in draw.sample(range(-60, 400), n):
        if draw.random() < hot:  # copies of one conversation
            turns = [("user", "a b"), ("bot", "a"), ("user", "")]
        else:
            turns = [(draw.choice(["user", "bot", None]), draw.choice(texts)) for _ in range(draw.choice([1, 2, 3, 5, 9]))]
        rows += [(c, None if i == 0 and draw.random() < 0.2 else i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard", [1, 9, 60, trie.SHARD_TURNS])
def test_nodes(spark, shard):
    rows = [*made(1, 150), (None, 1, "user", "a"), (7, 3, "user", "a"), (7, 3, "user", "a"), (7, 3, "bot", "tie")]
    got = trie.trie(trie.rebuilt_paths(frame(spark, rows)), shard).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(sequences(rows))
    plain = trie.trie(trie.paths(frame(spark, rows)), shard).collect()
    assert set(map(tuple, plain)) == brute(sequences(rows, rebuild=False))


def test_many_ends_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in [*range(0, 9000), -3]]
    got = trie.trie(trie.paths(frame(spark, rows))).collect()
    assert set(map(tuple, got)) == brute(sequences(rows, rebuild=False))


def test_turnless_and_empty(spark):
    # 1 takes its only turn (crc32 of "1" leaves 3) from conversation 0, which is absent
    got = trie.trie(trie.rebuilt_paths(frame(spark, [(1, 0, "user", "a")]))).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert trie.trie(trie.rebuilt_paths(frame(spark, []))).count() == 0


def test_double_array():
    draw = np.random.default_rng(3)
    paths = sorted({tuple(draw.integers(1, 40, draw.integers(1, 8)).tolist()) for _ in range(500)})
    lens = np.array([len(p) for p in paths])
    packed = trie.DoubleArray(np.array([t for p in paths for t in p]), lens)
    nodes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert sum(map(len, packed.levels)) == len(nodes) == len(np.unique(np.concatenate(packed.levels)))
    for p in paths:
        at = 0
        for t in p:
            to = packed.base[at] + t
            assert packed.check[to] == at
            at = to
    assert packed.used < 3 * len(nodes)
