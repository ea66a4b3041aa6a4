"""The session-log table: typed appends, idempotent per batch, and a purge that deletes whole days.

Rows lie under ``log_date=D/batch_id=B``. A batch replaces its own folders, so a batch that is run
twice gives the same rows; a purge lists the days alone and drops the folders of expired ones. Rows
without a day (a timestamp that can't be read) have no age and stay.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.sources.logs import RAW_LOG_SCHEMA, SESSION_LOG_SCHEMA, coerce_session_logs

PARTITIONS = ["log_date", "batch_id"]
STORED = T.StructType([*SESSION_LOG_SCHEMA.fields, T.StructField("log_date", T.DateType()), T.StructField("batch_id", T.StringType())])


def create_log_table(spark: SparkSession, target: str, name: str = "session_logs") -> None:
    """The log table under a name of its own, with its schema, for SQL; ``refresh_log_table`` shows it new days."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)}) LOCATION '{target}'")
    refresh_log_table(spark, name)


def refresh_log_table(spark: SparkSession, name: str = "session_logs") -> None:
    """Let the catalogue see days that were appended or purged."""
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)


def append_logs(raw: DataFrame, target: str, batch_id: str | int) -> None:
    """Type ``raw`` (all strings) and store it as batch ``batch_id``, in place of an earlier run of it."""
    logs = coerce_session_logs(raw).withColumns({"log_date": F.to_date("ts"), "batch_id": F.lit(str(batch_id))})
    logs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(target)


def read_logs(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(target).select(*SESSION_LOG_SCHEMA.fieldNames())


def purge_logs(spark: SparkSession, target: str, as_of: _dt.date, days: int) -> int:
    """Delete the days older than ``as_of`` - ``days``; the number of days that went."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    first = (as_of - _dt.timedelta(days=days)).isoformat()
    gone = 0
    for found in fs.globStatus(path(f"{target}/log_date=*")) or []:
        day = found.getPath().getName().removeprefix("log_date=")
        if day[:1].isdigit() and day < first:
            gone += bool(fs.delete(found.getPath(), True))
    return gone


def run_log_stream(spark: SparkSession, source_dir: str, target: str, checkpoint: str, days: int, as_of: Callable[[], _dt.date] = _dt.date.today) -> None:
    """Drain files of raw logs into ``target``; after each batch, purge as of the day it then is."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        append_logs(rows, target, batch_id)
        purge_logs(spark, target, as_of(), days)

    stream = spark.readStream.schema(RAW_LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source_dir)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
