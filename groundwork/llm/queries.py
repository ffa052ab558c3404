"""The registered opN_ queries: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import bpe, chats, codes, counts, jpeg, language, licenses, lm, oracles, packing, quality, sharding, simhash, trie
from groundwork.llm.common import documents, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op3_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


def op13_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.digests(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licenses, op2_lm_scores, op3_bpe_digests, op4_token_counts, op5_language, op6_packing, op7_quality_rules, op8_simhash, op9_jpeg_media, op10_sharding, op11_trie, op12_codes, op13_chats)
}
ORACLES: dict[str, str] = {"op1_licenses": oracles.licence_sql(), "op7_quality_rules": oracles.quality_sql(), "op11_trie": oracles.trie_sql(), "op12_codes": oracles.codes_sql(), "op13_chats": oracles.chats_sql()}
