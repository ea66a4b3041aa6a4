"""One maintained ``fact_act_est``: rebuilt as a batch, kept current by two change streams.

A change row ``(date, product_code, customer_code, <quantity>, ingest_seq)`` means "insert the key,
or set this quantity of the key". A null quantity counts as 0, like the gaps of the rebuild. The
table keeps the ``ingest_seq`` of each quantity, so an older change that arrives late loses, and a
batch that is applied again changes nothing.

The table is a Parquet folder partitioned by fiscal year and month, written by Spark alone: a batch
reads the months it touches, writes them merged to a folder of its own, and then replaces those
months by a dynamic partition overwrite. A batch that dies before the last step has changed nothing;
one that dies within it is applied again by the stream, with the same result. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.functions.dates import fiscal_year
from starledger.session import path_exists, shared_dir
from starledger.sources.act_est import integrate_act_est

KEYS = ["date", "product_code", "customer_code"]
SEQS = {"sold_quantity": "sold_seq", "forecast_quantity": "forecast_seq"}
ACT_EST_COLS = ["date", "fiscal_year", "product_code", "customer_code", "sold_quantity", "forecast_quantity"]
PARTITION_COLS = ["fiscal_year", "date"]
STORED = T.StructType(
    [T.StructField("product_code", T.LongType()), T.StructField("customer_code", T.LongType())]
    + [T.StructField(c, T.LongType()) for pair in SEQS.items() for c in pair]
    + [T.StructField("fiscal_year", T.IntegerType()), T.StructField("date", T.DateType())]
)


def change_schema(column: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("date", T.DateType(), False),
            T.StructField("product_code", T.LongType(), False),
            T.StructField("customer_code", T.LongType(), False),
            T.StructField(column, T.LongType(), True),
            T.StructField("ingest_seq", T.LongType(), False),
        ]
    )


def latest_changes(changes: DataFrame, column: str) -> DataFrame:
    """Newest change per key (highest ``ingest_seq``): a map-side combinable aggregate."""
    newest = F.max(F.struct("ingest_seq", F.coalesce(F.col(column).cast("bigint"), F.lit(0)).alias("q")))
    return changes.groupBy(*KEYS).agg(newest.alias("c")).select(*KEYS, F.col("c.q").alias(column), F.col("c.ingest_seq").alias(SEQS[column]))


def merge_changes(current: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """``current`` rows with ``changes`` (one row per key) applied to ``column``, by sequence number."""
    if column not in SEQS:
        raise ValueError(f"column must be one of {tuple(SEQS)}")
    seq = SEQS[column]
    new = changes.select(*KEYS, F.col(column).alias("_new"), F.col(seq).alias("_seq"))
    both = current.select(*KEYS, *(c for pair in SEQS.items() for c in pair)).join(new, KEYS, "full")
    wins = F.col("_seq") >= F.coalesce(F.col(seq), F.lit(-1))
    values = {column: F.when(wins, F.col("_new")).otherwise(F.col(column)), seq: F.when(wins, F.col("_seq")).otherwise(F.col(seq))}
    out = [F.coalesce(values.get(c, F.col(c)), F.lit(gap)).cast("bigint").alias(c) for q, s in SEQS.items() for c, gap in ((q, 0), (s, -1))]
    return both.select("date", fiscal_year("date").alias("fiscal_year"), "product_code", "customer_code", *out)


class ActEstTable:
    """The maintained table at ``root`` (a path on storage that all executors share)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self) -> bool:
        return path_exists(self.spark, self.root)

    def _stored(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.root)

    def read(self) -> DataFrame:
        """The table as of now; filters on fiscal_year and date prune directories."""
        return self._stored().select(*ACT_EST_COLS)

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        """A month is cut by size: as many ranges of its rows as Spark's sampled bounds give it."""
        cut = rows.repartitionByRange(*PARTITION_COLS, "customer_code", "product_code").sortWithinPartitions(*PARTITION_COLS, "customer_code", "product_code")
        cut.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*PARTITION_COLS).parquet(path)

    def rebuild(self, fact_sales: DataFrame, fact_forecast: DataFrame) -> None:
        """Replace the contents by the full outer join of the facts."""
        rows = integrate_act_est(fact_sales, fact_forecast)
        self._write(rows.withColumns({seq: F.lit(-1).cast("bigint") for seq in SEQS.values()}), self.root, "static")

    def upsert(self, batch: DataFrame, column: str) -> None:
        """Apply one batch of changes to the months it touches."""
        changes = latest_changes(batch.where("date is not null"), column)
        touched = batch.select("date", fiscal_year("date").alias("fiscal_year")).where("date is not null").distinct().collect()  # months of one batch
        if not touched:
            return
        current = self._stored().where(F.col("date").isin([r["date"] for r in touched]) & F.col("fiscal_year").isin(sorted({r["fiscal_year"] for r in touched})))
        merged = shared_dir(self.spark, "act-est-batch")
        merge_changes(current, changes, column).write.parquet(merged)
        self._write(self.spark.read.parquet(merged), self.root, "dynamic")


def run_upsert_stream(table: ActEstTable, source_dir: str, column: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Drain the change files under ``source_dir`` into ``table`` (availableNow trigger)."""
    changes = table.spark.readStream.schema(change_schema(column)).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    query = (
        changes.writeStream.foreachBatch(lambda df, batch_id: table.upsert(df, column))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stage_changes(changes: DataFrame, column: str, path: str) -> None:
    """Write change rows in date order, like a change feed: a file touches few months."""
    feed = changes.select(*KEYS, F.col(column).cast("bigint").alias(column), F.monotonically_increasing_id().alias("ingest_seq"))
    feed.repartitionByRange("date").write.mode("overwrite").parquet(path)


def replay(spark: SparkSession, feeds: list[tuple[DataFrame, str]], files_per_batch: int = 64) -> DataFrame:
    """An empty table after the change ``feeds`` (rows, column) were streamed into it in turn."""
    root = shared_dir(spark, "act-est")
    table = ActEstTable(spark, f"{root}/table")
    for k, (rows, column) in enumerate(feeds):
        stage_changes(rows, column, f"{root}/feed-{k}")
        run_upsert_stream(table, f"{root}/feed-{k}", column, f"{root}/checkpoint-{k}", files_per_batch)
    return table.read()
