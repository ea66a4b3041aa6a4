"""Co-purchase pair counts without emitting row pairs.

The reference self-joins the sales of one (customer, date) basket and counts
pairs ``(r1, r2)`` with ``r1.product < r2.product`` and different attribute
values, grouped by ``(attr(r1), attr(r2))``. A self-join emits every pair of a
basket, quadratic in its size.

Here the rows of a basket are first counted per (order key, value). Keys are then read digit by digit,
in base ``width``: two keys differ first at some digit, and at that digit their pair is counted. For the last
digit the rows are those counts; for each higher one, the counts of all keys that agree down to it are
summed. At each digit a running sum over two values' rows, ordered by the digit (RANGE frame ending one
unit before the row, so equal keys never pair: the reference's strict ``<``), gives the partners.

A window holds the rows of two values that agree in all higher digits: at most ``2 * width``, however large
the basket and however its keys are spaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base of the digits, a power of two.
WIDTH = 512


def ordered_pair_counts(
    rows: DataFrame,
    group: Sequence[str],
    order_key: str,
    attr: str,
    out_first: str,
    out_second: str,
    out_count: str = "frequency",
    width: int = WIDTH,
    keys: tuple[int, int] | None = None,
) -> DataFrame:
    """``keys``: least and greatest order key, where they are known (else one aggregate finds them)."""
    bits = width.bit_length() - 1
    base = rows.select(*group, F.col(order_key).cast("long").alias("_at"), attr).where(F.col("_at").isNotNull())
    if keys is None:
        keys = tuple(base.agg(F.min("_at"), F.max("_at")).first())
    low, high = (k or 0 for k in keys)
    level = base.groupBy(*group, "_at", attr).agg(F.count(F.lit(1)).alias("_rows"))
    counts = None
    while True:
        last = high - low < width
        digits = level.withColumn("_above", F.lit(0).cast("long") if last else F.shiftright("_at", bits))
        found = _earlier_partners(digits, [*group, "_above"], attr)
        counts = found if counts is None else counts.union(found)
        if last:
            break
        low, high = low >> bits, high >> bits
        level = digits.groupBy(*group, F.col("_above").alias("_at"), attr).agg(F.sum("_rows").alias("_rows"))
    pairs = counts.groupBy(F.col("_first").alias(out_first), F.col("_second").alias(out_second)).agg(F.sum("_n").alias(out_count))
    return pairs.filter(F.col(out_count) > 0)


def _earlier_partners(rows: DataFrame, group: Sequence[str], attr: str) -> DataFrame:
    """(_first, _second, _n): for each row, its ``_rows`` times those of lower ``_at`` in its group that
    have the partner's value, for each other value of the group."""
    partners = rows.select(*group, F.col(attr).alias("_partner")).distinct()
    expanded = rows.join(partners, list(group)).filter(F.col(attr) != F.col("_partner"))
    expanded = expanded.withColumn("_lo", F.least(attr, "_partner")).withColumn("_hi", F.greatest(attr, "_partner"))
    # Spread each group over its value pairs: without this the window would reuse the join's
    # partitioning and a large group would stay in one task.
    expanded = expanded.repartition(*group, "_lo", "_hi")
    earlier = Window.partitionBy(*group, "_lo", "_hi").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    # Frame rows share the partition's (_lo, _hi); add up each side separately and
    # take the side that is the current row's partner.
    earlier_lo = F.sum(F.when(F.col(attr) == F.col("_lo"), F.col("_rows"))).over(earlier)
    earlier_hi = F.sum(F.when(F.col(attr) == F.col("_hi"), F.col("_rows"))).over(earlier)
    partner = F.when(F.col(attr) == F.col("_hi"), earlier_lo).otherwise(earlier_hi)
    return expanded.select(F.col("_partner").alias("_first"), F.col(attr).alias("_second"), (F.col("_rows") * F.coalesce(partner, F.lit(0))).alias("_n"))
