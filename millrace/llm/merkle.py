"""Merkle manifest of a table: a digest of each row, a tree over each source's rows, and one over the sources.

The trees are worked through by time-forward processing.  A sweep goes over the nodes in the order of their labels; a
node's digest is a message to its parent, kept in a priority queue by the parent's label, so a parent finds its children's
digests at the queue's front when the sweep comes to it.  Messages to parents of a later sweep go to a table, which Spark
sorts by label for that sweep.  The way back is the same with labels reversed: a node sends each child its siblings'
digests and what it was sent itself, and leaves receive their proofs.

A sweep's task holds one shard, the subtree over at most 4,096 nodes, so a hot source is many shards.  Positions come from
range-sorting, with counts of ranges; no source is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import stored

FAN = 16

#: Levels that one sweep climbs: a shard has ``FAN ** LEVELS`` nodes.
LEVELS = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: Iterable[bytes]) -> bytes:
    """A parent's digest: that of its children's, as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def field(value: Column) -> Column:
    """Length and value, or ``-``, so that no two rows read alike."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def leaves(docs: DataFrame, altered: Column | None = None, to: Column | None = None) -> DataFrame:
    """``doc_id, source, tree, digest`` of each row, and ``changed``: its digest with the text ``to``, where ``altered`` holds."""
    cols = [docs[c] for c in FIELDS]
    changed = F.lit(None).cast("string") if altered is None else F.when(altered, leaf_digest([*cols[:-1], to]))
    tree = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))
    return docs.select(docs["doc_id"], docs["source"], tree.alias("tree"), F.unhex(leaf_digest(cols)).alias("digest"), F.unhex(changed).alias("changed"))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``index``, a row's place in its ``tree``, and ``n``, the rows of the tree."""
    ranged = stored(nodes.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "merkle-sorted")
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    every = Window.partitionBy("tree")  # of a tree's ranges, one row each
    before = F.sum("here").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(every).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    placed = ranged.withColumn("place", place).join(offsets, ["tree", "part"])
    return placed.withColumn("index", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def rounds(n: int, levels: int) -> int:
    """Levels to climb above ``n`` nodes, ``levels`` at most."""
    k = 0
    while n > 1 and k < levels:
        n, k = -(-n // FAN), k + 1
    return k


def sweep_up(digests: list[bytes], climb: int) -> list[list[bytes]]:
    """The digests of a shard's nodes by level, from the given ones to that of its top."""
    nodes = [digests, *([] for _ in range(climb))]
    queue = [((1, i // FAN), i, d) for i, d in enumerate(digests)] if climb else []
    heapify(queue)
    while queue:
        label = queue[0][0]
        run = []
        while queue and queue[0][0] == label:
            run.append(heappop(queue)[2])
        level, i = label
        digest = digest_of(run)
        nodes[level].append(digest)
        if level < climb:
            heappush(queue, ((level + 1, i // FAN), i, digest))
    return nodes


def sweep_down(nodes: list[list[bytes]], suffix: bytes) -> list[bytes]:
    """The proof of each lowest node, where that of the top is ``suffix``.

    A proof holds for each level the number of siblings, the node's place among them, and their digests from left to right.
    """
    proofs: list[bytes] = []
    queue = [(1 - len(nodes), 0, suffix)]
    while queue:
        level, i, suffix = heappop(queue)
        if level == 0:
            proofs.append(suffix)
            continue
        run = nodes[-level - 1][i * FAN:(i + 1) * FAN]
        for k in range(len(run)):
            heappush(queue, (level + 1, i * FAN + k, bytes((len(run) - 1, k)) + b"".join(run[:k] + run[k + 1:]) + suffix))
    return proofs


def levels_of(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(proof):
        n, place = proof[at], proof[at + 1]
        yield place, [proof[i:i + 32] for i in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf has by its proof."""
    for place, siblings in levels_of(proof):
        leaf = digest_of([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each shard; they come sorted by it."""
    now: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if now and (row["tree"], row["shard"]) != (now[0]["tree"], now[0]["shard"]):
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _up(levels: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def tops():
        for rows in _by_shard(batches):
            n = rows[0]["n"]
            nodes = sweep_up([r["digest"] for r in rows], rounds(n, levels))
            yield {"tree": rows[0]["tree"], "index": rows[0]["shard"], "n": -(-n // FAN**levels), "digest": nodes[-1][0]}

    yield from _batches(tops(), schema)


def _down(levels: int, schema: pa.Schema, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def reached():
        for top, *rows in _by_shard(batches):
            nodes = sweep_up([r["digest"] for r in rows], rounds(rows[0]["n"], levels))
            for row, proof in zip(rows, sweep_down(nodes, top["proof"]), strict=True):
                yield row | {"proof": proof, "subroot": top["subroot"], "root": top["root"]}

    yield from _batches(reached(), schema)


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    size = FAN**levels
    return nodes.withColumn("shard", F.floor(F.col("index") / size)).withColumn("place", F.col("index") % size)


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (``tree, index, n, digest``) and what is left of them after each sweep, down to one row for each tree."""
    passes = [nodes]
    while (passes[-1].agg(F.max("n")).first()[0] or 0) > 1:
        dealt = _dealt(passes[-1].select("tree", "index", "n", "digest"), levels)
        dealt = dealt.repartition("tree", "shard").sortWithinPartitions("tree", "shard", "place")
        passes.append(stored(dealt.mapInArrow(partial(_up, levels), "tree string, index bigint, n bigint, digest binary"), "merkle-nodes"))
    return passes


def descend(passes: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of ``passes[0]`` with ``proof, subroot, root``; ``tops`` has those of each tree's top."""
    given = tops.select("tree", F.lit(0).cast("bigint").alias("index"), "proof", "subroot", "root")
    for nodes in reversed(passes[:max(1, len(passes) - 1)]):
        above = given.select("tree", F.col("index").alias("shard"), "proof", "subroot", "root")
        both = _dealt(nodes, levels).unionByName(above, allowMissingColumns=True)
        both = both.repartition("tree", "shard").sortWithinPartitions("tree", "shard", F.col("place").isNotNull(), "place")
        kept = StructType([both.schema[c] for c in [*nodes.columns, "proof", "subroot", "root"]])
        given = both.mapInArrow(partial(_down, levels, _arrow(kept)), kept)
    return given


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def proofs(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` (from ``leaves``) with ``proof, subroot, root``, all binary.

    Within a source, rows go by ``doc_id`` (null first), and by digest where ids repeat; rows equal in all are leaves of their own.
    Sources go by their bytes, null first.  No rows: none.
    """
    at = stored(numbered(rows, "doc_id", "digest"), "merkle-leaves")
    passes = climb(at, levels)
    sources = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    above = climb(stored(numbered(sources, "of"), "merkle-sources"), levels)
    root = above[-1].select("tree", F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    tops = descend(above, root, levels).select(F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return descend(passes, stored(tops, "merkle-tops"), levels)


def checked(proven: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of rows with proofs.

    ``proof_sha256`` hashes the siblings' digests; ``folded_root`` starts from the changed leaf where there is one.
    """
    kept = proven.select("doc_id", "source", "digest", "changed", "proof", "subroot", "root")
    out = StructType([kept.schema[c] for c in ("doc_id", "source", "digest", "subroot", "root")]).add("proof_hash", "binary").add("folded", "binary")
    result = kept.mapInArrow(_fold, out)
    hexed: Callable[[str], Column] = lambda c: F.lower(F.hex(c))
    return result.select("doc_id", "source", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
                         hexed("proof_hash").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, folded = [], []
        for proof, leaf, changed in zip(*(batch.column(c).to_pylist() for c in ("proof", "digest", "changed")), strict=True):
            hashes.append(digest_of(s for _, siblings in levels_of(proof) for s in siblings))
            folded.append(fold(changed or leaf, proof))
        names = ["doc_id", "source", "digest", "subroot", "root"]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(hashes, pa.binary()), pa.array(folded, pa.binary())], [*names, "proof_hash", "folded"])


def tampered(docs: DataFrame) -> DataFrame:
    """The leaves of ``docs``; where 5 divides the crc32 of the decimal id, a change has lower-cased the text."""
    return leaves(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, lowered(docs["text"]))


def sql() -> str:
    """The checked rows in DuckDB's SQL."""
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
           " lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),"
           " lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)")

    def leaf(text: str) -> str:
        parts = (f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(parts)})"

    low = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"

    def up(leaves: str) -> str:
        return f"""
            SELECT 0 AS lvl, tree, idx, n, digest FROM {leaves}
            UNION ALL
            SELECT lvl + 1, tree, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM %s
            WHERE n > 1 GROUP BY lvl, tree, n, idx // 16"""

    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, source, {leaf("text")} AS digest,
                   CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS changed,
                   coalesce('=' || source, '') AS tree
            FROM documents),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
                   count(*) OVER (PARTITION BY tree) AS n
            FROM leaves),
        nodes AS ({up("placed") % "nodes"}),
        subroots AS (
            SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n
            FROM nodes WHERE n = 1),
        uppers AS ({up("subroots") % "uppers"}),
        kin AS (
            SELECT p.tree, p.idx, 0 AS stage, s.lvl, s.idx AS at, s.digest, s.idx < p.idx // (16 ** s.lvl)::BIGINT AS before
            FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.idx // 16 = p.idx // (16 ** (s.lvl + 1))::BIGINT
                 AND s.idx <> p.idx // (16 ** s.lvl)::BIGINT
            UNION ALL
            SELECT p.tree, p.idx, 1, s.lvl, s.idx, s.digest, s.idx < r.idx // (16 ** s.lvl)::BIGINT
            FROM placed p JOIN subroots r ON r.of = p.tree JOIN uppers s ON s.n > 1 AND s.idx // 16 = r.idx // (16 ** (s.lvl + 1))::BIGINT
                 AND s.idx <> r.idx // (16 ** s.lvl)::BIGINT),
        steps AS (
            SELECT p.tree, p.idx, l.stage, l.lvl,
                   row_number() OVER (PARTITION BY p.tree, p.idx ORDER BY l.stage, l.lvl) AS step
            FROM placed p JOIN (SELECT DISTINCT tree, 0 AS stage, lvl FROM nodes WHERE n > 1
                                UNION ALL SELECT t.tree, 1, u.lvl FROM (SELECT DISTINCT tree FROM placed) t, (SELECT DISTINCT lvl FROM uppers WHERE n > 1) u) l
                 ON l.tree = p.tree),
        sides AS (
            SELECT s.tree, s.idx, s.step, coalesce(string_agg(k.digest, '' ORDER BY k.at) FILTER (k.before), '') AS l,
                   coalesce(string_agg(k.digest, '' ORDER BY k.at) FILTER (NOT k.before), '') AS r
            FROM steps s LEFT JOIN kin k ON k.tree = s.tree AND k.idx = s.idx AND k.stage = s.stage AND k.lvl = s.lvl
            GROUP BY s.tree, s.idx, s.step),
        hashed AS (SELECT tree, idx, string_agg(l || r, '' ORDER BY step) AS proof, max(step) AS last FROM sides GROUP BY tree, idx),
        folds AS (
            SELECT tree, idx, CAST(0 AS BIGINT) AS step, changed AS digest FROM placed
            UNION ALL
            SELECT f.tree, f.idx, s.step, sha256(s.l || f.digest || s.r)
            FROM folds f JOIN sides s ON s.tree = f.tree AND s.idx = f.idx AND s.step = f.step + 1)
        SELECT p.doc_id, p.source, p.digest AS leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(h.proof, '')) AS proof_sha256,
               f.digest AS folded_root, f.digest = t.digest AS verified
        FROM placed p JOIN subroots r ON r.of = p.tree CROSS JOIN (SELECT digest FROM uppers WHERE n = 1) t
             LEFT JOIN hashed h ON h.tree = p.tree AND h.idx = p.idx
             JOIN folds f ON f.tree = p.tree AND f.idx = p.idx AND f.step = coalesce(h.last, 0)"""
