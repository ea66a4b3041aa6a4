"""Exact CUME_DIST cut-offs, computed distributed.

The reference picks ``MIN(x) WHERE CUME_DIST() OVER (ORDER BY x) >= p``. A
window without PARTITION BY pulls all rows into one task, and an exact
percentile aggregate keeps every distinct value in one buffer. Here:

1. rows are counted per distinct value (map-side partial aggregation, so a
   value held by a third of the rows collapses to one row before the shuffle);
2. the distinct values are range-partitioned, as for a distributed sort; each partition is a
   bucket, and buckets are ordered ranges. The bucketed values are checkpointed, so every later
   step sees the same buckets;
3. per-bucket counts (one row per partition) give, through a window over buckets, the number of
   rows in all lower buckets;
4. inside each bucket a running sum over the ordered distinct values gives
   ``#rows <= x``; ``cume = (rows in lower buckets + running) / N`` — exact;
5. the cut-off is ``MIN(x) WHERE cume >= p``, a global aggregate.

Nothing is collected; the only driver-visible values are one-row scalars. There are as many buckets
as the session has shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.session import cut_lineage



def _bucketed(stacked: DataFrame) -> DataFrame:
    """(_k, _v) rows counted per distinct value, with the range bucket ``_b``; nulls form rows of their own."""
    counts = stacked.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(counts.repartitionByRange("_k", "_v").withColumn("_b", F.spark_partition_id()))


def _cume(stacked: DataFrame) -> DataFrame:
    """Distinct non-null ``_v`` of each ``_k`` with ``_cd``, the share of its rows that aren't greater.

    NULLs sort first in an ascending window, so they count as lower than any value.
    """
    counts = _bucketed(stacked)
    per_bucket = counts.groupBy("_k", "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_k", "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"))
    totals = per_bucket.groupBy("_k").agg(F.sum("_bn").alias("_total"))
    upto = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("_run", F.sum("_n").over(upto))
    return (
        running.join(offsets, ["_k", "_b"])
        .join(totals, "_k")
        .filter(F.col("_v").isNotNull())
        .select("_k", "_v", ((F.col("_before") + F.col("_run")).cast("double") / F.col("_total").cast("double")).alias("_cd"))
    )


def cume_dist_by_value(df: DataFrame, value: str) -> DataFrame:
    """Distinct non-null ``value`` with ``cume_dist`` = fraction of rows with value <= it."""
    return _cume(df.select(F.lit(0).alias("_k"), F.col(value).alias("_v"))).select(F.col("_v").alias(value), F.col("_cd").alias("cume_dist"))


def cume_dist_cutoffs(df: DataFrame, value: str, probs: Sequence[float]) -> list[Column]:
    """Scalar columns ``MIN(value) WHERE CUME_DIST() OVER (ORDER BY value) >= p`` per ``p``.

    All cut-offs of one column come from one scalar subquery (a struct).
    """
    cd = cume_dist_by_value(df.select(value), value)
    fields = [F.min(F.when(F.col("cume_dist") >= F.lit(float(p)), F.col(value))).alias(f"p{i}") for i, p in enumerate(probs)]
    packed = cd.agg(F.struct(*fields).alias("cut")).scalar()
    return [packed.getField(f"p{i}") for i in range(len(probs))]


def cume_dist_cutoffs_many(df: DataFrame, specs: dict[str, Sequence[float]], as_type: str = "decimal(38,4)") -> dict[str, list[Column]]:
    """``cume_dist_cutoffs`` for several columns in one pass.

    The columns are stacked as ``(column id, value)`` rows (values cast to the common exact type
    ``as_type``), so one pass serves all of them. Returns, per column, the cut-off scalars in
    ``specs`` order.
    """
    cols = list(specs)
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("_k"), F.col(c).cast(as_type).alias("_v")) for i, c in enumerate(cols)])).alias("_s")
    ).select("_s._k", "_s._v")
    cd = _cume(stacked)
    fields = []
    for i, c in enumerate(cols):
        for j, p in enumerate(specs[c]):
            fields.append(F.min(F.when((F.col("_k") == i) & (F.col("_cd") >= F.lit(float(p))), F.col("_v"))).alias(f"c{i}_{j}"))
    packed = cd.agg(F.struct(*fields)).scalar()
    return {c: [packed.getField(f"c{i}_{j}") for j in range(len(specs[c]))] for i, c in enumerate(cols)}
