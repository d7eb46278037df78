"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that looks disguised becomes a lattice: each of its characters may stand for itself,
for a letter it resembles, or for nothing (a separator, a repetition).  Viterbi decoding under a character trigram model
of the whole corpus picks the letters; runs of single characters are decoded as one token.

The score adds the log-odds of the strongest words and word beginnings, learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, row_slices, stored, utf8

# What a sign may stand for, and signs that may only separate.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = frozenset(".-_*'~·/\\,:;#%&^")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SIGNS = 0, 27, 28
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
# Costs of the channel, in nats.
SUBSTITUTE, DROP_SEPARATOR, DROP_REPEAT, KEEP_REPEAT = 0.7, 0.3, 0.5, 1.5

#: Bound of the labelled rows that the weights are fitted on, of each label.
MOST_LABELLED = 6_000
LEAST_DOCS, LEAST_ODDS, MOST_FEATURES = 6, 3.0, 4_000
#: A feature's toxic count may come about by chance, over all features of ``LEAST_DOCS`` texts, with this probability at most.
CHANCE = 0.01
#: And so many of all labelled documents with it must be toxic.
LEAST_PRECISION = 0.9
#: Most log-odds of a text without evidence, however many of the labels are toxic: their share is not that of the texts.
NO_EVIDENCE = math.log(0.1 / 0.9)
#: The name of what any evidence adds to the log-odds; no word is empty.
ANY = ""
PREFIXES = (4, 5, 6)
SMALLEST_RUN, WINDOW = 4, 24
#: Runs are of tokens of one character, and so many of them in a row at least.
SINGLE, SPACED = (1).__eq__, b"\1" * SMALLEST_RUN

TOKEN = re.compile(r"[^\x00-\x20]+")
WORD = re.compile(r"[^\W_]+")
#: A repeated sign, a sign that stands for a letter, or a separator within.
DISGUISED = re.compile(r"(\w)\1|[0-9@$!|+(€]|\w[.\-_*'~·/\\,:;#%&^]+\w", re.S)
TRIM = "\"“”«»()[]{}<>.,:;?#%&^*~'"


def trigram_rows(docs: DataFrame) -> DataFrame:
    """``code, n``: how often each three signs follow each other in the words of all texts."""
    table = np.full(256, OTHER, np.int64)
    for c, i in CODE.items():
        table[ord(c)] = table[ord(c.upper())] = i
    table[[*b" \t\n\r\x0b\x0c"]] = EDGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIGNS**3, np.int64)
        for batch in row_slices(batches, 1_000, "text", 4_000_000):
            text = b"  " + b"  ".join(batch.column("text").to_pylist()) + b"  "
            signs = table[np.frombuffer(text, np.uint8)]
            counts += np.bincount(signs[:-2] * SIGNS**2 + signs[1:-1] * SIGNS + signs[2:], minlength=SIGNS**3)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["code", "n"])

    partial = docs.select(utf8(docs, "text").alias("text")).mapInArrow(run, "code bigint, n bigint")
    return partial.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs of a sign after two others; at most ``SIGNS ** 3`` counts reach the driver."""
    counts = np.full((SIGNS, SIGNS, SIGNS), 0.1)
    for row in trigram_rows(docs).collect():
        code = row["code"]
        counts[code // SIGNS**2, code // SIGNS % SIGNS, code % SIGNS] += row["n"]
    bigram = counts.sum(axis=0)
    smooth = bigram / bigram.sum(axis=1, keepdims=True)
    return -np.log((counts + 5 * smooth[None]) / (counts.sum(axis=2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, ``""`` for nothing, and the cost."""
    out = []
    for i, c in enumerate(token):
        before = token[i - 1] if i else ""
        if c in CODE:
            edges = [(c, 0.0)]
            if c == before:
                edges = [("", DROP_REPEAT), (c, KEEP_REPEAT)]
        elif c in LEET:
            edges = [(x, SUBSTITUTE) for x in LEET[c]]
            if c == before:
                edges = [("", DROP_REPEAT), *((x, cost + KEEP_REPEAT) for x, cost in edges)]
        elif c in SEPARATORS:
            edges = [("", DROP_SEPARATOR)]
        else:
            edges = [("", DROP_REPEAT), (c, KEEP_REPEAT)] if c == before else [(c, 0.0)]
        out.append(edges)
    return out


def restore(token: str, costs: np.ndarray) -> str:
    """The likeliest letters of a disguised token: a Viterbi path through its lattice."""
    states = {(EDGE, EDGE): (0.0, None)}
    for edges in lattice(token):
        following: dict = {}
        for (a, b), (cost, path) in states.items():
            for letter, channel in edges:
                if letter:
                    sign = CODE.get(letter, OTHER)
                    state, total, way = (b, sign), cost + channel + costs[a, b, sign], (path, letter)
                else:
                    state, total, way = (a, b), cost + channel, path
                if state not in following or total < following[state][0]:
                    following[state] = (total, way)
        states = following
    _, path = min(((cost + costs[a, b, EDGE], way) for (a, b), (cost, way) in states.items()), key=lambda s: s[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Words of restored texts; remembers the tokens it has met."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, list[str]] = {}
        self.hits: dict[str, tuple[tuple[str, float], ...]] = {}
        self.weights: dict[str, float] | None = None

    def words(self, token: str) -> list[str]:
        """The words of a token as it stands, and as restored if it looks disguised."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[token] = self._words(token)
        return found

    def _words(self, token: str) -> list[str]:
        found = WORD.findall(token)
        inner = token.strip(TRIM)
        if DISGUISED.search(inner):
            for form in {inner, inner.rstrip("!")}:
                found = found + WORD.findall(restore(form, self.costs))
        return found

    def evidence(self, text: str, weights: dict[str, float]) -> tuple[dict[str, float], set[str]]:
        """The words of a text that have a weight, each with the most of it and its beginnings, and the stretches.

        A token is looked through once: most have no such word, and share one empty tuple.
        """
        if self.weights is not weights:
            self.weights, self.hits = weights, {}
        elif len(self.hits) > 300_000:
            self.hits.clear()
        tokens = TOKEN.findall(text.lower())
        hits, found = self.hits, {}
        for token in set(tokens):
            hit = hits.get(token)
            if hit is None:
                by_word = ((w, strongest_of(w, weights)) for w in self._words(token))
                hit = hits[token] = tuple((w, best) for w, best in by_word if best)
            if hit:
                found.update(hit)
        return found, self._stretches(tokens)

    def document(self, text: str) -> tuple[set[str], set[str]]:
        """Its words, restored ones too, and the stretches of its spaced-out runs."""
        tokens = TOKEN.findall(text.lower())
        out: set[str] = set()
        for token in set(tokens):
            out.update(self.words(token))
        return out, self._stretches(tokens)

    def _stretches(self, tokens: list[str]) -> set[str]:
        """All stretches of the restored letters of spaced-out runs."""
        stretches: set[str] = set()
        if SPACED not in bytes(map(SINGLE, map(len, tokens))):
            return stretches
        run: list[str] = []
        for token in [*tokens, ""]:
            if len(token) == 1 and (token.isalpha() or token in LEET) or run and token and token in SEPARATORS:
                run.append(token)
                continue
            if len(run) >= SMALLEST_RUN:
                joined = re.sub(r"(.)\1{2,}", r"\1\1", "".join(run))
                if len(joined) >= SMALLEST_RUN:
                    letters = restore(joined, self.costs)
                    stretches.update(letters[i:i + n] for n in range(SMALLEST_RUN, WINDOW + 1) for i in range(len(letters) - n + 1))
            run = []
        return stretches


def features(words: set[str]) -> set[str]:
    """Whole words, and beginnings of longer ones, which say the same whatever ending follows."""
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> tuple[float, dict[str, float]]:
    """The log-odds of a text without evidence and the weights, from labelled documents that are not held out.

    Up to about ``MOST_LABELLED`` of each label, by a hash of the id, are read; with fewer, all.
    Counts are grouped by Spark; at most ``MOST_FEATURES`` weights reach the driver.
    """
    toxic = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = toxic.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in toxic.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return (-20.0 if not sizes.get(1) else NO_EVIDENCE), {}
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = toxic.where(share < F.when(F.col("toxic") == 1, min(1.0, MOST_LABELLED / sizes[1])).otherwise(
        min(1.0, MOST_LABELLED / sizes[0])))
    # About 2 * MOST_LABELLED ids at most, so they go to the texts: only texts of the sample are shuffled, and kept for both passes.
    sample = F.broadcast(stored(sample, "labelled-ids"))
    rows = docs.select("doc_id", utf8(docs, "text").alias("text")).join(sample, "doc_id")
    rows = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled-texts")  # copies do not vote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(costs), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[y].update(features(restorer.document(text.decode("utf-8", "replace"))[0]))
                counts[y][""] += 1  # all texts
        keys = list(counts[1])  # a feature of no toxic document here adds nothing but to its clean count
        rest = [k for k in counts[0] if k not in counts[1]]
        for names in (keys, rest):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][k] for k in names], pa.int64()),
                 pa.array([counts[0][k] for k in names], pa.int64())], ["feature", "t", "c"])

    counted = rows.mapInArrow(run, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = stored(counted, "features")
    texts = counted.where("feature = ''").first()
    total = {1: texts["t"] if texts else 0, 0: texts["c"] if texts else 0}
    if not total[1] or not total[0]:
        return min(math.log(sizes[1] / sizes[0]), NO_EVIDENCE), {}
    # Chernoff's bound of the chance to see so many toxic ones among the texts with a feature.
    base, n, share_toxic = total[1] / (total[0] + total[1]), F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c"))
    clean_part = F.when(share_toxic < 1, (1 - share_toxic) * F.log((1 - share_toxic) / (1 - base))).otherwise(0.0)
    surprise = n * (share_toxic * F.log(share_toxic / base) + clean_part)
    # Two more clean documents than were seen: what is rare must not look strong.
    odds = F.log((F.col("t") + 0.5) / (total[1] + 1)) - F.log((F.col("c") + 2.0) / (total[0] + 2))
    strong = counted.where((F.col("t") >= LEAST_DOCS) & (F.col("feature") != "")).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    strong = strong.where(surprise >= math.log(max(1, counted.where(n >= LEAST_DOCS).count()) / CHANCE))
    toxic_docs, clean_docs = F.col("t") * sizes[1] / total[1], F.col("c") * sizes[0] / total[0]
    strong = strong.where(toxic_docs >= LEAST_PRECISION * (toxic_docs + clean_docs))
    best = strong.orderBy(F.desc(F.col("odds") * F.log1p("t")), "feature").limit(MOST_FEATURES).collect()
    prior, weights = math.log(sizes[1] / sizes[0]), {r["feature"]: r["odds"] for r in best}

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = Restorer(costs), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found[y] += not strongest(text.decode("utf-8", "replace"), restorer, weights)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(found, pa.int64())], ["y", "n"])

    counts = {r["y"]: r["n"] for r in rows.mapInArrow(without, "y int, n bigint").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    absent = {y: (counts.get(y, 0) + 0.5) / (total[y] + 1) for y in (0, 1)}
    intercept = min(prior + math.log(absent[1] / absent[0]), NO_EVIDENCE)
    return intercept, weights | {ANY: prior - intercept}


#: How many of a document's strongest features count, and how much each after the first.
SHARES = (1.0, 0.5, 0.25)


def strongest_of(word: str, weights: dict[str, float]) -> float:
    """The most weight of a word and its beginnings, 0 if they have none."""
    return max((weights.get(f, 0.0) for f in (word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n))), default=0.0)


def strongest(text: str, restorer: Restorer, weights: dict[str, float]) -> list[float]:
    """The weights of a text's strongest features."""
    words, stretches = restorer.evidence(text, weights)
    by_word = list(words.values())
    by_word += [best for s in stretches if (best := max(weights.get(s, 0.0), weights.get(s + "*", 0.0) if len(s) in PREFIXES else 0.0))]
    return sorted(by_word, reverse=True)[:len(SHARES)]


def score_text(text: str, restorer: Restorer, prior: float, weights: dict[str, float]) -> float:
    found = strongest(text, restorer, weights)
    z = prior + (weights.get(ANY, 0.0) if found else 0.0) + sum(w * s for w, s in zip(found, SHARES, strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, costs: np.ndarray, prior: float, weights: dict[str, float]) -> DataFrame:
    """All columns of ``docs`` and ``score``, from 0 to 1; a null or empty text has that of no evidence.

    Every whole text is scored alone: repeated rows score alike.  No shuffle.
    """
    schema = docs.drop("score").schema.simpleString()[len("struct<"):-1]
    names = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in row_slices(batches, 1_000, "text", 4_000_000):
            scores = [score_text(t or "", restorer, prior, weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])
            del scores, batch
        del restorer
        release()

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{schema}, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with a model of these documents and labels."""
    costs = language_model(docs)
    return score(docs, costs, *train(docs, labels, costs))
