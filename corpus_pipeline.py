"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread
as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starledger.llm import stages
from starledger.llm.common import read_table, staged

STAGES = [
    ("language_id", stages.keep_known_language),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_benchmark_leaks),
    ("best_fit_packing", stages.pack),
]

#: Language scores and token ids aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
