"""Queries of the operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starledger.llm import chat, decontamination, embedding, htmltext, langid, minhash, oracle, orchard, packing, prefixtrie, sharding, tokenfile, toxicity, urls
from starledger.llm.common import read_table

#: Parameters of the registered queries.
SEQUENCE_TOKENS = 2048
PACK_END_ID = 0
FILE_END_ID = 2
SHARDS = 24
TOXIC_FROM = 0.7
CLUSTERS, ROUNDS, DIMENSIONS = 8, 10, 64
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer, PACK_END_ID, SEQUENCE_TOKENS)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(read_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.store_tokens(read_table(spark, sf_dir, "documents"), tokenizer, FILE_END_ID)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), TOXIC_FROM)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster_vectors(read_table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMENSIONS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_language_id,
        op4_kd_sharding,
        op5_url_filter,
        op6_html_extraction,
        op7_token_orc,
        op8_decontamination,
        op9_minhash_near_dedup,
        op10_embedding_near_dedup,
        op11_prefix_trie,
        op12_toxicity,
        op13_centroid_clustering,
    )
}
#: Tokenizers, trained models, minimum cuts, k-d cuts and spaced seeds are held against brute force in tests/llm.
ORACLE_SQL = {
    "op2_chat_formatting": oracle.CHAT,
    "op9_minhash_near_dedup": oracle.NEAR_DEDUP,
    "op10_embedding_near_dedup": oracle.EMBEDDINGS,
    "op11_prefix_trie": oracle.TRIE,
    "op13_centroid_clustering": oracle.clusters(CLUSTERS, ROUNDS, DIMENSIONS),
}
