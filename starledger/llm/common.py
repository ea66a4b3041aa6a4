"""Shared folder, staged tables and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.session import shared_dir

#: Rows in one Arrow batch sent to Python: texts can be long, so batches are kept short.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which all executors share."""
    return shared_dir(spark, f"llm-{name}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later readers don't recompute its
    lineage and lost executors don't lose it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts in rows and bytes (session settings; smaller ones stay)."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def exact_columns(df: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """Only the named columns, cast: a table's other columns can't clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns))


_REMEMBERS: list = []


def remember_alone(owner=None) -> None:
    """In a Python worker, which serves one operator after the other: let other owners of a memo
    forget theirs, so that what is kept from finished stages doesn't add up."""
    for other in _REMEMBERS[:]:
        if other is not owner:
            other.forget()
            _REMEMBERS.remove(other)
    if owner is not None and not _REMEMBERS:
        _REMEMBERS.append(owner)


def utf8_bytes(text: Column) -> Column:
    """UTF-8 length of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def prefix_sums(sums: DataFrame, within: list[str], order: str, value: str, out: str) -> DataFrame:
    """``sums`` with ``out``: the total of ``value`` in the rows before, by ``order`` within ``within``.

    For pre-aggregated tables (a row for each task or file and key), not for rows of the input.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


#: Rows of a table of ids that may be broadcast (16 MB of longs); larger ones are joined by shuffle.
BROADCAST_IDS = 2_000_000


def bounded_broadcast(ids: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a staged table of a few numbers a row), marked for broadcast if it is small enough."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids
