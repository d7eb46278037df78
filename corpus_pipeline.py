"""A training corpus from raw documents, in five stages over all of them.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, curriculum, partenum, secrets, toxicity
from millrace.llm.common import read, stored
from millrace.llm.queries import TOXIC_FROM, VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``TOXIC_FROM``."""
    scored = toxicity.judged(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < TOXIC_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; one of rows equal in id and text.  Rows without an id stay."""
    groups = partenum.similar_documents(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.select(docs.columns).union(docs.where("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced and ``n_chars`` that of the new text."""
    masked = secrets.redact(docs, secrets.train(spark))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, those taken twice as two rows; what the targets leave out goes."""
    return curriculum.assign(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.decode(bpe.encode(docs, vocabulary), vocabulary), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained models and similarity classes are beyond SQL; ``tests/llm`` checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
