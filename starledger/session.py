"""Session helpers: sensible defaults for local runs and a shared scratch location."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "starledger") -> SparkSession:
    """A local session for tests and benchmarks (the library itself never creates sessions)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of one partition of a shuffle, as long as there are at most so many partitions; bytes up to which AQE merges them.
SHUFFLE_ROWS, MOST_SHUFFLED, MERGED_BYTES = 1 << 17, 4096, "4m"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let shuffles of ``rows`` rows start with partitions that a task sorts in a few MB, whatever the session's
    default: a sort that spills often holds a reader's buffers for each of its runs. A larger number of partitions
    or a size that the session names stays."""
    wanted = min(MOST_SHUFFLED, -(-rows // SHUFFLE_ROWS))
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        if int(spark.conf.get(key, None) or (200 if key.endswith("shuffle.partitions") else wanted)) < wanted:
            spark.conf.set(key, wanted)
    if wanted > 1 and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED_BYTES)


#: Lets Spark delete the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query that starts in the block deletes its shuffle files as it ends; else they stay until the driver
    happens to collect its garbage, and those of a chain of writes add up. The session's setting comes back after."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/starledger/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder (``spark.checkpoint.dir``).

    Only a local session (one machine, as in tests) may lack the setting and gets a folder of its
    own; on a cluster a machine's own folder would hold incomplete tables, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="starledger-ckpt-")  # kept by the context: Spark lets no session set it later
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever storage ``path`` names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever storage ``path`` names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (eager) checkpoint to the shared checkpoint folder: the result survives
    executor loss and later readers do not recompute its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
