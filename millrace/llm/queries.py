"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe,
    curriculum,
    html_main,
    lm_score,
    merkle,
    partenum,
    secrets,
    simple8b,
    spherical,
    topk,
    toxicity,
    trie,
    url_filter,
)
from millrace.llm.common import read
from millrace.session import work_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages"), html_main.train(spark))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES, url_filter.train(spark))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_documents(read(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-shards")
    simple8b.write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END_ID)
    return simple8b.checksums(simple8b.read_shards(spark, path))


TOXIC_FROM = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.judged(docs, read(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = curriculum.plan(read(spark, sf_dir, "documents"))
    ordered = planned.orderBy("first_position", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0, by_row=True)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), secrets.train(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(read(spark, sf_dir, "documents"), vocabulary)
    return bpe.digests(bpe.decode(encoded, vocabulary))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt_paths(read(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(merkle.proofs(merkle.tampered(read(spark, sf_dir, "documents"))))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        op1_main_text, op2_url_filter, op3_ngram_join, op4_token_shards, op5_toxicity, op6_embedding_dedup, op7_curriculum, op8_top_k, op9_secrets, op10_bpe,
        op11_prefix_trie, op12_merkle_manifest, op13_lm_score)}


def oracle_sql() -> dict[str, str]:
    return {"op7_curriculum": curriculum.sql(), "op8_top_k": topk.sql(5, 50), "op11_prefix_trie": trie.sql(), "op12_merkle_manifest": merkle.sql()}
