"""Token ids of whole texts by way of their different words.

A text's ids are those of its white-space separated pieces, one after the other:
the vocabulary's pre-tokenizer drops white space and never joins across it.  A
worker numbers the pieces of a slice of texts by Arrow, looks each different one up and
only tokenizes pieces it has not met, so the cost follows the different words, not the words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Fixed values of the vocabulary file: its pre-tokenizer, as it cuts plain pieces, and special tokens.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\s\w]|_)+|\n")
SPECIAL = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>")

#: What no plain piece has.  Up to U+024F lower-casing, composition and the letter classes are the
#: same in every Unicode version; other pieces go to the library as they are.
ODD = re.compile(r"[^\n\x20-\x7e\xa1-\xac\xae-\u024f]|<\|")


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Numbers(dict):
    """Numbers what it is asked for and has not met, and keeps that in ``new``."""

    def __init__(self, *known: str):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


class Store:
    """Runs of ids, by number, in one growing row."""

    def __init__(self):
        self.starts, self.lens, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.runs = self.used = 0

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.runs + len(lens) > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[self.runs:self.runs + len(lens)] = self.used + np.cumsum(lens) - lens
        self.lens[self.runs:self.runs + len(lens)] = lens
        self.flat[self.used:self.used + len(flat)] = flat
        self.runs, self.used = self.runs + len(lens), self.used + len(flat)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after the other, and where each ends."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(total)], ends


class PieceCache:
    """Maps pieces to ids; ``encode_words`` gives the ids of words not met before, in a row, and their counts.

    Holds at most about ``limit`` pieces and starts afresh beyond, with those of the slice at hand that it has, so memory is bounded.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 encode_odd: Callable[[str], np.ndarray], limit: int = 300_000):
        self.encode_words, self.encode_odd, self.limit = encode_words, encode_odd, limit
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.words = Numbers("\n")
        self.of_pieces, self.of_words = Store(), Store()
        self.of_words.add(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def renew(self, wanted: list[bytes]) -> None:
        """Starts afresh with what it has of the wanted pieces."""
        kept = [p for p in wanted if p in self.pieces]
        flat, ends = self.of_pieces.take(np.fromiter(map(self.pieces.__getitem__, kept), np.int64, len(kept)))
        self.clear()
        self._keep(kept, flat, np.diff(ends, prepend=0))

    def _add(self, new: list[bytes]) -> None:
        text = b"\n".join(new).decode("utf-8", "replace")
        usual, odd = new, []
        if ODD.search(text):
            texts = text.split("\n")
            plain = [not ODD.search(t) for t in texts]
            usual = [p for p, yes in zip(new, plain, strict=True) if yes]
            odd = [(p, t) for p, t, yes in zip(new, texts, plain, strict=True) if not yes]
            text = "\n".join([t for t, yes in zip(texts, plain, strict=True) if yes])
        if usual:
            tokens = SPLIT.findall(text.lower() + "\n")
            at = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            if self.words.new:
                self.of_words.add(*self.encode_words(self.words.new))
                self.words.new = []
            flat, ends = self.of_words.take(at)
            self._keep(usual, flat, np.diff(ends[at == 0], prepend=0))
        if odd:
            ids = [self.encode_odd(t) for _, t in odd]
            self._keep([p for p, _ in odd], np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _keep(self, pieces: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces)), strict=True))
        self.of_pieces.add(flat, lens)

    def encode(self, texts: list[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        # White space at either end leaves an empty piece, which has no ids.
        split = pc.ascii_split_whitespace(column.fill_null(b"").view(pa.string()))
        coded = split.values.dictionary_encode()
        at = self.numbers(coded.dictionary)
        flat, ends = self.of_pieces.take(at[coded.indices.to_numpy(zero_copy_only=False)])
        last = split.offsets.to_numpy(zero_copy_only=False)[1:]
        return flat, np.diff(np.concatenate([[0], ends])[last], prepend=0)

    def numbers(self, different: pa.Array) -> np.ndarray:
        """The number in ``of_pieces`` of each of some different pieces."""
        every = different.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.pieces) > self.limit:
            self.renew(every)
        at = np.fromiter(map(self.pieces.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(at < 0)
        if len(new):
            pieces = [every[i] for i in new.tolist()]
            self._add(pieces)
            at[new] = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        return at
