"""The stages of the corpus pipeline, each one of the operators applied to what its predecessor kept.

All take any rows: null, empty and very long texts, repeated rows, empty tables, and columns beside those of
``documents``, whatever their names. The first three return rows of ``docs`` as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starledger.llm import decontamination, langid, minhash, packing
from starledger.llm.common import read_table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter (or text) go. Rows that repeat are judged
    alike; a null doc_id doesn't matter; without a labelled document no language is learned and all go."""
    return langid.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates. Documents without a word or an
    id are linked with nothing and stay; rows that repeat a doc_id are one document and stay or go together."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Documents without a text or an id stay, as all do if the
    benchmark is empty."""
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the kept documents' pieces in sequences of 2048 tokens: a row for each piece, no longer the
    columns of ``documents``. A null text is empty and gives the end id alone; repeated rows are packed each
    for itself."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
