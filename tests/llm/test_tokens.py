"""BPE and Simple-8b against the library, and exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, simple8b
from millrace.llm.pieces import PieceCache
from millrace.llm.queries import END_ID, VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
TEXTS = [
    "", None, "   \n", "The the THE", "it's we're O'NEIL'S !!'s", "aaaaaaa aaa", "<|endoftext|>hi<|startoftext|> x",
    "ÀÉ é é ñ Ǆ İstanbul ΣΑΣ", "日本語 テスト 🎉🎉 123 4.5²½", "a\x1cb a\x85b a b", "word " * 30_000, "x" * 50_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(spark, texts):
    data = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id bigint, text string, key string, ids string")


def test_encode_and_decode_equal_the_library(spark, library):
    docs = rows(spark, TEXTS + TEXTS[:6])
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(got) == len(TEXTS) + 6
    for i, text in enumerate(TEXTS + TEXTS[:6]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["text"] == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    for r in bpe.digests(bpe.decode(bpe.encode(rows(spark, TEXTS), PATH), PATH)).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    library = Tokenizer.from_file(PATH)
    for cache in (bpe.loaded(PATH).cache, simple8b._loaded(PATH)):
        ids, counts = cache.encode([t.encode("utf-8", "ignore") for t in texts])
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            t = t.encode("utf-8", "ignore").decode()
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_merges_that_a_later_rank_outruns(tmp_path):
    """A token made by two merges: a pair of it outranks the second of them."""
    from tokenizers import models

    import json

    symbols = bpe.byte_symbols()
    tokens = [*symbols, *(s + "</w>" for s in symbols), "ab", "abc", "abx", "bc"]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    merges = [["b", "c"], ["a", "bc"], ["abc", "x</w>"], ["a", "b"], ["ab", "c"]]
    vocab.update({"abcx</w>": len(vocab)})
    full = json.load(open(PATH, encoding="utf-8"))
    full["model"].update(vocab=vocab, merges=merges)
    full["added_tokens"] = []
    path = tmp_path / "v.json"
    path.write_text(json.dumps(full))
    assert isinstance(Tokenizer.from_file(str(path)).model, models.BPE)
    words = ["abcx", "abcabcx", "aabc", "abab"]
    flat, counts = bpe.PairIndexBpe(str(path)).encode_words(words)
    lib = Tokenizer.from_file(str(path))
    assert np.split(flat, np.cumsum(counts)[:-1])[0].tolist() == lib.encode(words[0]).ids
    assert [a.tolist() for a in np.split(flat, np.cumsum(counts)[:-1])] == [lib.encode(w).ids for w in words]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.integers(0, 3), max_size=3000))
def test_pack_round_trip(ids):
    words, offsets = simple8b.pack(np.array(ids, np.uint64), 256)
    assert simple8b.unpack(words, offsets, len(ids), 256).tolist() == ids


def test_shards(spark, library, tmp_path):
    docs = rows(spark, TEXTS).unionByName(rows(spark, TEXTS[2:4])).repartition(3)
    path = str(tmp_path / "shards")
    simple8b.write_shards(docs, path, PATH, END_ID)
    got = sorted(simple8b.checksums(simple8b.read_shards(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in docs.collect())
    start = 0
    lists = {i: [*library.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in enumerate(TEXTS)}
    lists2 = {i: [*library.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in enumerate(TEXTS[2:4])}
    for r in got:
        assert r["start"] == start
        want = [x for x in (lists[r["doc_id"]], lists2.get(r["doc_id"])) if x]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
        start += r["n_tokens"]


def test_empty_table(spark, tmp_path):
    empty = rows(spark, TEXTS).limit(0)
    assert bpe.digests(bpe.decode(bpe.encode(empty, PATH), PATH)).count() == 0
    simple8b.write_shards(empty, str(tmp_path / "none"), PATH, END_ID)
    assert simple8b.checksums(simple8b.read_shards(spark, str(tmp_path / "none"))).count() == 0


def test_columns_are_encoded_as_they_are():
    met = []

    def encode_words(words):
        met.extend(words)
        return np.array([len(w) for w in words], np.int32), np.ones(len(words), np.int64)

    cache = PieceCache(encode_words, lambda piece: np.zeros(1, np.int32), limit=4)
    column = pa.array([b"skipped", b" one  three\n", None, b"", b"\t", b"three. one.", b"skipped"], pa.binary()).slice(1, 5)
    ids, counts = cache.encode(column)
    assert ids.tolist() == [3, 5, 5, 1, 3, 1] and counts.tolist() == [2, 0, 0, 0, 4]
    ids, counts = cache.encode([b"one.one", None])
    assert ids.tolist() == [3, 1, 3] and counts.tolist() == [3, 0]
    assert len(cache.pieces) < 4 and sorted(met) == [".", ".", "one", "one", "three"]  # it started afresh


def test_a_worker_gives_back_its_memory_at_the_end_of_a_task(monkeypatch, spark):
    released = []
    monkeypatch.setattr(bpe, "release", lambda: released.append(len(bpe.loaded(PATH).cache.pieces)))

    class Docs:  # runs the task's function in this process
        schema = spark.createDataFrame([], "doc_id bigint, text string").schema
        columns = ["doc_id", "text"]

        def __getitem__(self, name):
            return F.col(name)

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"some text"])], ["key", "text"])
            self.out = list(run(iter([batch])))
            return self

        def withColumnRenamed(self, *_):
            return self

    assert bpe.encode(Docs(), PATH).out[0].num_rows == 1
    assert released == [0]


def test_a_full_cache_keeps_what_comes_again():
    met = []

    def encode_words(words):
        met.extend(words)
        return np.array([len(w) for w in words], np.int32), np.ones(len(words), np.int64)

    cache = PieceCache(encode_words, lambda piece: np.zeros(1, np.int32), limit=3)
    cache.encode([b"often one", b"three seven"])
    ids, counts = cache.encode([b"eleven often"])
    assert ids.tolist() == [6, 5] and counts.tolist() == [2]
    assert met.count("often") == 1 and sorted(cache.pieces) == [b"eleven", b"often"]
