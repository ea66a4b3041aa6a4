"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc ids.

Documents are range-partitioned by doc_id, so file k holds smaller ids than file k + 1 and readers
skip whole files, stripes and row groups by ``doc_id`` (min/max from the indexes, then the Bloom
filter). Each file is read in parallel by stripes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm.common import exact_columns, prefix_sums, scratch, short_batches
from starledger.llm.encode import encoder, slices

ROWS = "doc_id long, chunk int, chunk_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = True) -> None:
    """Encode ``docs`` (doc_id, text) whole, append ``end_id`` and write ORC files in doc_id order.

    A null text is empty; null doc_ids come first; rows with one doc_id are ordered by text, and
    spread over files if they are many. An empty table writes an empty file. ``chunk`` numbers the
    files in order, ``chunk_start`` counts the ids before a document in its file.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        chunk, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, keeps_space)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, run in slices(texts):
                ids = enc.encode(run)
                n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(end.join([*ids, b""]))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(run)), pa.array(np.full(len(run), chunk, np.int32)), pa.array(start + ends - n), pa.array(n), lists],
                    names=["doc_id", "chunk", "chunk_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    short_batches(docs.sparkSession)
    rows = exact_columns(docs, [("doc_id", "long"), ("text", "string")])
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie, F.monotonically_increasing_id())
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(encode, ROWS).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of the named documents: the filter reaches the ORC reader, which prunes by its indexes."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document: doc_id, start (ids of all documents before it), n_tokens and
    the unsigned CRC-32 of its ids as little-endian 32-bit integers, both from the ids read."""

    def check(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values, dtype="<i4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "chunk", "chunk_start", "n_tokens", "ids_crc32"])

    short_batches(spark)
    rows = read_tokens(spark, path)
    files = rows.groupBy("chunk").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    bases = prefix_sums(files.withColumn("all", F.lit(0)), ["all"], "chunk", "n", "base").select("chunk", "base")
    found = rows.select("doc_id", "chunk", "chunk_start", "ids").mapInArrow(check, "doc_id long, chunk int, chunk_start long, n_tokens long, ids_crc32 long")
    return found.join(bases, "chunk").select("doc_id", (F.col("base") + F.col("chunk_start")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` to ORC (a new path in the shared folder if none is given); its digest, read back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens-orc")
    write_tokens(docs, path, tokenizer, end_id)
    return digest(spark, path)
