"""BPE encoding and decoding with a pair occurrence index.

The different words of a slice of texts are laid out as one row of symbols.  An
index maps each mergeable pair, by its rank, to all its positions.  The active
ranks are taken in ascending order from a heap; a rank merges all its positions
at once and adds the pairs that arise to the lists of their ranks.

Words are independent, so the lowest rank of all words is the lowest of every word
that has it, and each word sees the merges that it would see alone.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, row_slices, utf8
from millrace.llm.pieces import SPECIAL, PieceCache, load_tokenizer

NONE = np.int32(2**31 - 1)
SLICE_ROWS, SLICE_BYTES = 1_000, 4_000_000
#: Rows whose tokens are spread out at once, an object each, beside the worker that encodes.
DECODED_ROWS = 200


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class PairIndexBpe:
    """The vocabulary in a file, and merging by pair occurrence index."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        self.size = max(vocab.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.twin = left == right
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # A token made by several merges may enter a pair that outranks a later one of
        # them; such ranks merge one position of a word at a time.
        first_use = np.full(self.size, NONE, np.int32)
        np.minimum.at(first_use, left, np.arange(len(merges), dtype=np.int32))
        np.minimum.at(first_use, right, np.arange(len(merges), dtype=np.int32))
        self.singly = first_use[self.result] < np.arange(len(merges))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.cache = PieceCache(self.encode_words, self.encode_odd)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and how many each has."""
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        chars = np.frombuffer(b"".join(raw), np.uint8)
        n = len(chars)
        ends = np.cumsum(lens)
        sym = self.inner[chars]
        sym[ends - 1] = self.final[chars[ends - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), lens)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends - lens] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, NONE, np.int32)
        has = np.flatnonzero(nxt >= 0)
        rank[has] = self._rank(sym[has], sym[nxt[has]])

        index: dict[int, list[np.ndarray]] = defaultdict(list)  # rank -> positions of its pair
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            of = rank[positions]
            keep = of != NONE
            positions, of = positions[keep], of[keep]
            order = np.argsort(of, kind="stable")
            positions, of = positions[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            heads = of[np.concatenate([[0], cuts])] if len(of) else of
            for r, group in zip(heads.tolist(), np.split(positions, cuts), strict=False):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(group)

        enter(has)
        while active:
            r = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if self.singly[r]:
                once = np.unique(word[at], return_index=True)[1]
                rest, at = np.delete(at, once), at[once]
                enter(rest)
            elif self.twin[r] and len(at) > 1:  # a a a: the first two merge
                keep, last = [], -1
                for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if p != last:
                        keep.append(p)
                        last = q
                at = np.array(keep)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.result[r]
            alive[gone] = False
            rank[gone] = NONE
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            touched = np.unique(np.concatenate([at, before[before >= 0]]))
            follow = nxt[touched]
            rank[touched] = np.where(follow >= 0, self._rank(sym[touched], sym[np.maximum(follow, 0)]), NONE)
            enter(touched)
        return sym[alive], np.bincount(word[alive], minlength=len(raw))

    def encode_odd(self, piece: str) -> np.ndarray:
        """Ids of a piece with rare characters or special tokens."""
        out, at = [], 0
        for m in [*SPECIAL.finditer(piece), None]:
            text = piece[at:m.start() if m else len(piece)]
            if text:
                normal = self.tokenizer.normalizer.normalize_str(text)
                words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
                if words:
                    out.append(self.encode_words([self._text(w) for w in words])[0])
            if m:
                out.append(np.array([self.special[m.group()]], np.int32))
                at = m.end()
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    _bytes = {s: b for b, s in enumerate(byte_symbols())}

    def _text(self, symbols: str) -> str:
        return bytes(self._bytes[s] for s in symbols).decode("utf-8")


def vocabulary_tokens(path: str) -> np.ndarray:
    """The token of each id."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    ids = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
    tokens = np.full(max(ids.values()) + 1, "", object)
    for token, i in ids.items():
        tokens[i] = token
    return tokens


_LOADED: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    """One copy of the vocabulary and its cache for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of every whole text, special strings included.

    ``vocabulary`` is the path of a vocabulary file that all executors have.  A null or empty text has no ids; repeated
    keys give a row each; other columns are left out.  One narrow stage: no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in row_slices(batches, SLICE_ROWS, "text", SLICE_BYTES):
            ids, counts = bpe.cache.encode(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])
        bpe.cache.clear()  # the worker may serve other stages next
        release()

    source = docs.select(docs[key].alias("key"), utf8(docs, text).alias("text"))
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, text``: the ids' tokens, special ones too, joined by a space.

    A vocabulary file that names no decoder asks for that.  No ids, or null, give an empty text.
    """
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_tokens(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                lists = part.column("ids")
                flat = tokens[lists.flatten().to_numpy(zero_copy_only=False)].tolist()
                ends = np.cumsum([n or 0 for n in pa.compute.list_value_length(lists).to_pylist()]).tolist()
                texts = [" ".join(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), lists, pa.array(texts, pa.string())], ["key", "ids", "text"])
                del flat, texts, lists, part
            del batch
        release()

    source = encoded.select(encoded[key].alias("key"), "ids")
    return source.mapInArrow(run, f"key {kind}, ids array<int>, text string").withColumnRenamed("key", key)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded documents, and ``more`` of their columns."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
