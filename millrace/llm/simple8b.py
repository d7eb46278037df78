"""Token ids of documents, packed by Simple-8b words into shards.

A 64-bit word holds a selector in its upper four bits and 60 bits of ids of equal
width, as many as fit.  Selector 0 is the escape: the word after it is one id of up
to 64 bits.  Ids are packed in blocks of ``BLOCK``; each block starts at a word of
its own, and its word offset is kept, so blocks pack and unpack in lockstep.

A shard row is a run of whole documents in ascending key order: ``shard, start``
(ids of the shard before it), ``keys``, ``counts`` (ids of each document), ``offsets``
(first word of each block) and ``words`` (little-endian).  Rows are kept in a
Parquet folder: Spark commits its files, so lost executors leave no half shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import parts, release, row_slices, utf8
from millrace.llm.pieces import PieceCache, load_tokenizer

# Ids in a word and bits of each, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
SELECTORS = range(1, 15)
#: Most ids of a word.
ROOM = int(COUNTS.max())

BLOCK = 1024
ROW_IDS_BYTES = 4_000_000
SLICE_ROWS = 1_000


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and the first word of each block."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = np.zeros((blocks, block + ROOM), np.uint64)  # past a block's end its last word may be part-filled
    held[:, :block] = np.pad(ids, (0, blocks * block - n)).reshape(blocks, block)
    held = held.ravel()
    choice = _choices(np.frexp(held.astype(np.float64))[1].astype(np.int8))  # one bit too many where rounded up: an escape at worst
    at = np.arange(blocks) * (block + ROOM)
    stop = np.minimum(at + block, at + n - np.arange(blocks) * block)
    taken: list[np.ndarray] = []
    while len(at):  # one word of each block at a time
        taken.append(at)
        on = at + COUNTS[choice[at]]
        more = on < stop
        at, stop = on[more], stop[more]
    begin = np.sort(np.concatenate(taken))
    chosen = choice[begin]
    sizes = np.where(chosen == 0, 2, 1)
    place = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    for s in SELECTORS:
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        word, i = np.full(len(mine), s << 60, np.uint64), begin[mine]
        for j in range(COUNTS[s]):
            word |= held[i + j] << np.uint64(j * WIDTHS[s])
        words[place[mine]] = word
    escaped = np.flatnonzero(chosen == 0)
    words[place[escaped] + 1] = held[begin[escaped]]
    firsts = place[np.searchsorted(begin, np.arange(blocks) * (block + ROOM))]
    return words, firsts


def _choices(bits: np.ndarray) -> np.ndarray:
    """The densest selector that fits from each id on, 0 if none."""
    widest, reach, choice = bits, 1, np.zeros(len(bits), np.int8)
    for s in reversed(SELECTORS):
        while reach < COUNTS[s]:  # of ``reach`` ids from each on
            more = min(reach, int(COUNTS[s]) - reach)
            widest = np.append(np.maximum(widest[:-more], widest[more:]), widest[-more:])
            reach += more
        choice[widest <= WIDTHS[s]] = s
    return choice


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids that ``pack`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)  # words that an escape announces
    if (selector == 0).any():
        for i in np.flatnonzero(selector == 0).tolist():
            if not raw[i]:
                raw[i + 1] = True
    raw = raw[:-1]
    size = np.where(raw, 0, COUNTS[selector])
    which = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    before = np.cumsum(size) - size
    first = which * (block + ROOM) + before - before[offsets][which]
    held = np.zeros((-(-n // block), block + ROOM), np.uint64)  # the last word of a block may be part-filled
    flat = held.ravel()
    for s in SELECTORS:
        mine = np.flatnonzero((selector == s) & ~raw)
        mask, i, of = np.uint64((1 << int(WIDTHS[s])) - 1), first[mine], words[mine]
        for j in range(COUNTS[s] if len(mine) else 0):
            flat[i + j] = (of >> np.uint64(j * WIDTHS[s])) & mask
    escapes = np.flatnonzero((selector == 0) & ~raw)
    flat[first[escapes]] = words[escapes + 1]
    return held[:, :block].ravel()[:n]


class LibraryCache(PieceCache):
    """Ids by the tokenizers library, each word encoded once."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        from tokenizers import Tokenizer, pre_tokenizers

        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.plain = Tokenizer(self.tokenizer.model)  # for words that are normal and cut already
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        super().__init__(self._words, self._odd)

    def _odd(self, piece: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, np.int32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i:i + 200]) for i in range(0, len(words), 200)]
        encoded = self.plain.encode_batch_fast(lines, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int32) for e in encoded])
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)


_LOADED: dict[str, LibraryCache] = {}


def _loaded(path: str) -> LibraryCache:
    if path not in _LOADED:
        _LOADED[path] = LibraryCache(path)
    return _LOADED[path]


SHARDS = ("shard int, start bigint, n_ids bigint, keys array<bigint>, counts array<bigint>, "
          "offsets array<bigint>, words binary")


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes all documents, in ascending ``doc_id`` order, as shards below ``path``.

    A null or empty text is its end id alone.  Rows of one ``doc_id`` stand together, ordered by
    a hash of their text; a null ``doc_id`` comes first.  Other columns are not written.
    The only shuffle is the range partitioning, whose ranges also split one repeated id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, start, shard = _loaded(vocabulary), 0, TaskContext.get().partitionId()
        for batch in row_slices(batches, SLICE_ROWS, "text", ROW_IDS_BYTES):
            ids, counts = cache.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            words, offsets = pack(ids)
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "start": start, "n_ids": len(ids), "keys": batch.column("doc_id").to_pylist(),
                "counts": counts + 1, "offsets": offsets, "words": words.astype("<u8").tobytes(),
            }], schema=_SCHEMA)
            start += len(ids)
        release()

    source = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), utf8(docs, "text").alias("text"))
    ordered = (source.withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(parts(docs.sparkSession), "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie"))
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(path)


_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.binary()),
])


def read_shards(spark, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the shards below ``path``.

    ``start`` counts the ids of all documents before it.  The totals that carry it from
    shard to shard are one small row for each shard, joined by the shard's number.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = {row["shard"]: row["n"] for row in shards.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(totals):
        before[shard], total = total, total + totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                ids = unpack(words, np.array(row["offsets"], np.int64), row["n_ids"]).astype(np.int64)
                ends = np.cumsum(row["counts"])
                starts = before[row["shard"]] + row["start"] + ends - np.array(row["counts"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(starts), lists], ["doc_id", "start", "ids"])

    return shards.mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def checksums(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of documents read from shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy().astype("<u4")
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends - n, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
