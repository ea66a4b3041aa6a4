"""Session-log table: typed schema, literal-row ingest and the events stand-in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ts DATETIME, session_id INT, user_id INT, log TEXT — ids widened to BIGINT so
# event ids of any size fit.
SESSION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("session_id", T.LongType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("log", T.StringType(), True),
    ]
)

RAW_LOG_SCHEMA = T.StructType([T.StructField(f.name, T.StringType(), True) for f in SESSION_LOG_SCHEMA.fields])


def coerce_session_logs(raw: DataFrame) -> DataFrame:
    """String columns -> typed columns (the INSERT ... VALUES coercion)."""
    return raw.select(
        F.to_timestamp_ntz(F.col("ts")).alias("ts"),
        F.col("session_id").cast("bigint").alias("session_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("log").cast("string").alias("log"),
    )


def session_logs_from_rows(spark: SparkSession, rows: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Typed session logs from literal (ts, session_id, user_id, log) string rows."""
    return coerce_session_logs(spark.createDataFrame(list(rows), schema=RAW_LOG_SCHEMA))


def raw_logs_from_events(events: DataFrame) -> DataFrame:
    """The events table as raw (all-string) log rows."""
    log = F.concat(F.upper(F.col("event_type")), F.lit(" | "), F.col("props"))
    return events.select(F.col("ts").cast("string").alias("ts"), F.col("event_id").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("user_id"), log.alias("log"))


def read_events(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
