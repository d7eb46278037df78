"""Conversation prefix trie, as double-array tries of its shards.

A turn is known by 20 bytes: a digest of role and text, and the words of the text.  A conversation is the row of
its turns' bytes, its *path*; equal paths become one, with the number of its conversations and their smallest id.
Paths are range-sorted and cut into shards.  A shard gives its turns dense ids, packs the nodes of its paths into
the arrays BASE and CHECK (the child of node ``s`` by turn ``c`` is at ``BASE[s] + c``, where CHECK names ``s``), walks
every path through them and sums up what the nodes hold.

Only prefixes of a shard's first and last path can occur in other shards.  Each node belongs to the first shard that
holds it, and a shard knows the path before its first; so what shards say of a shared node can be added up, in one
grouping of the few shared nodes, however deep they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.curriculum import words

#: Bytes of a turn in a path, of which the last four count words.
TURN = 20

#: Turns of the paths of one shard, which bounds a task's memory; a longer path is a shard of its own.
SHARD_TURNS = 200_000

#: Conversation ids that are joined within one row: those that share all but their last 12 bits.
CHUNK_BITS = 12

NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = ("node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, gross bigint, own bigint, ends_sha256 string")


def turn_bytes(role: Column, text: Column) -> Column:
    """A turn as 40 hexadecimal digits; null role or text as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * (TURN - 4)), F.lpad(F.hex(words(text)), 8, "0"))


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path`` of each conversation as it stands.

    Turns go by ``turn``, null first; of those with one number the smaller digest.  Rows without ``conv_id`` are of no conversation.
    """
    return _own(conversations).select("conv_id", _joined(F.col("own")))


def rebuilt_paths(conversations: DataFrame, shared: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id, path`` with the first turns of each conversation taken from the one whose id is the next lower multiple of ``shared``.

    As many turns as the crc32 of the decimal id leaves, divided by ``heads``.  Otherwise as ``paths``.
    """
    base = F.col("conv_id") - F.col("conv_id") % shared
    # no more than 2 * shared conversations have one base
    near = Window.partitionBy("base")
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads - 1)), ignorenulls=True).over(near)
    own = _own(conversations.withColumn("base", base), "base").withColumn("head", head)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.array().cast("array<string>")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return own.select("conv_id", _joined(turns))


def _own(conversations: DataFrame, *by: str) -> DataFrame:
    """``conv_id, own``: the turns in order.  With a column of ``by`` the rows are dealt by that alone."""
    turns = conversations.where("conv_id IS NOT NULL").select(*by, "conv_id", "turn", turn_bytes(F.col("role"), F.col("text")).alias("bytes"))
    turns = turns.repartition(*by) if by else turns
    grouped = turns.groupBy(*by, "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "bytes"))).alias("turns"))
    return grouped.select(*by, "conv_id", F.col("turns.bytes").alias("own"))


def _joined(turns: Column) -> Column:
    return F.unhex(F.array_join(turns, "")).alias("path")


def distinct_paths(convs: DataFrame) -> DataFrame:
    """``path, n, least, ends``: each path, its conversations, their smallest id and the digest of their ids.

    Ids are joined in chunks of a bounded number first, so that the task which must hash a hot path's ids in a row reads few rows.
    """
    chunks = convs.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.min("conv_id").alias("least"))
    chunks = chunks.select("path", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("bigint").alias("n"), "least")
    return chunks.repartition("path").sortWithinPartitions("path", "chunk").mapInArrow(_hash_ends, "path binary, n bigint, least bigint, ends string")


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now and now[0] == row["path"]:
                now[1] += row["n"]
                now[3].update(b"," + row["ids"].encode())
            else:
                if now:
                    done.append(now)
                now = [row["path"], row["n"], row["least"], hashlib.sha256(row["ids"].encode())]
        if done:
            yield _as_paths(done)
    if now:
        yield _as_paths([now])


def _as_paths(rows: list[list]) -> pa.RecordBatch:
    path, n, least, digests = zip(*rows, strict=True)
    return pa.record_batch([pa.array(path, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array([d.hexdigest() for d in digests])],
                           ["path", "n", "least", "ends"])


class DoubleArray:
    """BASE and CHECK over the turns of sorted, distinct paths, packed level by level.  Node 0 is the root."""

    def __init__(self, turns: np.ndarray, lens: np.ndarray):
        """``turns``: the dense ids of all paths in a row, from 1; ``lens``: how many each path has."""
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        self.used, self.hole = 1, 1
        self.turns, self.lens = turns, lens
        self.starts = np.cumsum(lens) - lens
        self.levels: list[np.ndarray] = [np.zeros(1, np.int64)]
        active, at = np.arange(len(lens)), np.zeros(len(lens), np.int64)
        depth = 0
        while len(active := active[lens[active] > depth]):
            parent, turn = at[active], turns[self.starts[active] + depth]
            # paths with one beginning stand side by side
            first = np.ones(len(active), bool)
            first[1:] = (parent[1:] != parent[:-1]) | (turn[1:] != turn[:-1])
            self.levels.append(self._pack(parent[first], turn[first]))
            at[active] = self.base[parent] + turn
            depth += 1

    def _pack(self, parent: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Places the children of a level's nodes; those of one parent stand side by side."""
        begins = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        sizes = np.diff(np.r_[begins, len(parent)])
        for b, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            codes = turn[b:b + n]
            low = int(codes.min())
            span = int(codes.max()) - low + 1
            self._grow(self.used + span)
            free = np.flatnonzero(self.check[self.hole:self.used] < 0)[:16] + self.hole
            slot = next((f for f in free.tolist() if (self.check[f + codes - low] < 0).all()), self.used)
            self._place(int(parent[b]), slot - low, codes)
        lone = begins[sizes == 1]
        if len(lone):
            holes = np.flatnonzero(self.check[self.hole:self.used] < 0)[:len(lone)] + self.hole
            slots = np.r_[holes, self.used + np.arange(len(lone) - len(holes))]
            self._grow(int(slots[-1]) + 1)
            self.base[parent[lone]], self.check[slots] = slots - turn[lone], parent[lone]
            self.used = max(self.used, int(slots[-1]) + 1)
            self.hole = int(slots[-1]) + 1
        return self.base[parent] + turn

    def _place(self, parent: int, base: int, codes: np.ndarray) -> None:
        self.base[parent], self.check[base + codes] = base, parent
        self.used = max(self.used, base + int(codes.max()) + 1)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.check, np.full(more, -1, np.int64)]

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level from the root: the paths that reach it and the nodes they stand at."""
        active, at = np.arange(len(self.lens)), np.zeros(len(self.lens), np.int64)
        depth = 0
        while len(active):
            yield active, at[active]
            active = active[self.lens[active] > depth]
            to = self.base[at[active]] + self.turns[self.starts[active] + depth]
            if not (self.check[to] == at[active]).all():
                raise ValueError("a path leaves the trie")
            at[active] = to
            depth += 1


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    most = min(len(a), len(b)) // TURN
    x, y = (np.frombuffer(p, np.uint8, most * TURN).reshape(most, TURN) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else most


def shard_nodes(before: bytes | None, path: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard's sorted paths, after the path ``before`` of the shard before it (null: there is none)."""
    lens = np.fromiter((len(p) // TURN for p in path), np.int64, len(path))
    row = b"".join(path)
    dense: dict[bytes, int] = {}
    turns = np.fromiter((dense.setdefault(row[i:i + TURN], len(dense) + 1) for i in range(0, len(row), TURN)), np.int64, len(row) // TURN)
    weight_of = np.r_[0, np.fromiter((int.from_bytes(t[-4:], "big") for t in dense), np.int64, len(dense))]
    trie = DoubleArray(turns, lens)
    size = trie.used
    n_convs, smallest, last = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64)
    depths, weight, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    left, right = np.zeros(lens[0] + 1, np.int64), np.zeros(lens[-1] + 1, np.int64)
    for depth, (paths_here, nodes) in enumerate(trie.walk()):
        np.add.at(n_convs, nodes, n[paths_here])
        np.minimum.at(smallest, nodes, least[paths_here])
        depths[nodes] = depth
        if depth:
            weight[nodes] = weight_of[turns[trie.starts[paths_here] + depth - 1]]
        ending = lens[paths_here] == depth
        last[nodes[ending]] = paths_here[ending]
        if paths_here[0] == 0:
            left[depth] = nodes[0]
        if paths_here[-1] == len(path) - 1:
            right[depth] = nodes[-1]
    known = -1 if before is None else _common(before, path[0])
    owned, shared = np.ones(size, bool), np.zeros(size, bool)
    owned[left[:known + 1]] = False
    shared[left[:known + 1]] = shared[right] = True
    children, inner = np.zeros(size, np.int64), np.zeros(size, bool)
    leaves[last >= 0] = 1
    for nodes in trie.levels[1:]:
        np.add.at(children, trie.check[nodes], owned[nodes])
        inner[trie.check[nodes]] = True
    leaves[inner] = 0
    if before is not None and len(before) == known * TURN:
        leaves[left[known]] -= 1  # the shard before took it for a leaf
    gross, own = n_convs * weight, owned * weight
    for nodes in trie.levels[:0:-1]:
        above = trie.check[nodes]
        for sums in (gross, own, leaves):
            np.add.at(sums, above, sums[nodes])
    names = {int(s): k for p, way in ((path[0], left[:known + 1]), (path[-1], right)) for s, k in zip(way.tolist(), _names(p), strict=False)}
    nodes = np.concatenate(trie.levels)
    above = trie.check[nodes]
    lone = ~shared[above]
    return pa.record_batch([
        pa.array([names.get(s) for s in nodes.tolist()], pa.binary()),
        pa.array([names.get(a) if s else None for s, a in zip(nodes.tolist(), above.tolist(), strict=True)], pa.binary()),
        pa.array(depths[nodes]), pa.array(smallest[nodes]), pa.array(smallest[above], mask=~lone), pa.array(n_convs[nodes]), pa.array(children[nodes]),
        pa.array(leaves[nodes]), pa.array(gross[nodes]), pa.array(own[nodes]),
        pa.array([ends[i] if i >= 0 else None for i in last[nodes].tolist()], pa.string())], [c.split()[0] for c in NODES.split(", ")])


def _names(path: bytes) -> Iterator[bytes]:
    """A digest for each beginning of a path, from the empty one."""
    name = b"root"
    yield name
    for i in range(0, len(path), TURN):
        name = hashlib.blake2b(name + path[i:i + TURN], digest_size=16).digest()
        yield name


def _shards(most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by ``part``; the first of a part may hold the last path of the part before it."""
    part = before = None
    path, n, least, ends, turns = [], [], [], [], 0

    def shard():
        return shard_nodes(before, path, np.array(n, np.int64), np.array(least, np.int64), ends)

    for batch in batches:
        for row in batch.to_pylist():
            if path and (row["part"] != part or turns >= most):
                yield shard()
                before = path[-1]
                path, n, least, ends, turns = [], [], [], [], 0
            if row["part"] != part:
                part, before = row["part"], None
            if row["n"] is None:
                before = row["path"]
                continue
            path.append(row["path"])
            n.append(row["n"])
            least.append(row["least"])
            ends.append(row["ends"])
            turns += len(row["path"]) // TURN
    if path:
        yield shard()


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie over ``conv_id, path`` (from ``paths`` or ``rebuilt_paths``), from the root.

    ``conv_id`` (smallest member), ``depth, parent_conv_id`` (the parent's), ``n_convs, n_children, n_leaves, saved_tokens``
    (over the subtree: words of a node's last text, for each conversation but one) and ``ends_sha256``, the digest of the
    ascending ids of conversations that end here.  No conversation: no row.  Ids that occur twice count as two conversations.
    One conversation's path, 20 bytes a turn, must fit into a row.
    """
    convs = stored(convs, "conversation-paths")
    ranged = stored(distinct_paths(convs).repartitionByRange("path").withColumn("part", F.spark_partition_id()), "sorted-paths")
    # one row for each range: the last path of the range before
    lasts = ranged.groupBy("part").agg(F.max("path").alias("path"))
    before = lasts.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "path").where("part IS NOT NULL")
    bounds = before.select("path", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("string").alias("ends"), "part")
    dealt = ranged.union(bounds).repartition("part").sortWithinPartitions("part", F.col("n").isNotNull(), "path")
    return _merged(stored(dealt.mapInArrow(partial(_shards, shard_turns), NODES), "shard-nodes"))


def _merged(nodes: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "gross", "own")]
    shared = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    ids = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lone = nodes.where("node IS NULL")
    within = lone.where("parent IS NULL").drop("node", "parent")
    across = lone.where("parent IS NOT NULL").drop("node", "parent_conv_id").join(ids, "parent").drop("parent")
    upper = shared.join(ids, "parent", "left").drop("node", "parent")
    every = within.unionByName(across).unionByName(upper)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("gross") - F.col("own")).alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def sql() -> str:
    """The nodes of the rebuilt conversations in DuckDB's SQL, with every prefix written out."""
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),"
           " lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),"
           " lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)")
    return f"""
        WITH own AS (
            SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS own
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
            WHERE conv_id IS NOT NULL GROUP BY conv_id),
        heads AS (SELECT conv_id, own, CAST({crc} % 4 AS BIGINT) AS h FROM own),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.own[:c.h], []), c.own[c.h + 1:]) AS turns
            FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
        prefixes AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[:d] AS prefix FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
        nodes AS (
            SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM prefixes GROUP BY depth, prefix),
        kin AS (SELECT depth, prefix[:depth - 1] AS above, prefix, conv_id, n_convs, ends_sha256 FROM nodes),
        named AS (
            SELECT k.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM kin c WHERE c.depth = k.depth + 1 AND c.above = k.prefix) AS n_children,
                   CASE WHEN k.depth = 0 THEN 0 ELSE (k.n_convs - 1) * len(regexp_extract_all(k.prefix[k.depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
            FROM kin k LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.prefix = k.above),
        below AS (SELECT n.n_children, n.saved, d AS depth, n.prefix[:d] AS prefix FROM named n, LATERAL (SELECT unnest(range(n.depth + 1)) AS d)),
        sums AS (SELECT depth, prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY depth, prefix)
        SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM named n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix"""
