"""Top-k operators.

* ``top_n``: global ORDER BY ... LIMIT n. Spark plans TakeOrderedAndProject
  (each partition keeps n rows, the final merge sees n x partitions rows).
* ``top_n_per_group``: rank window + filter. Spark inserts a partial
  WindowGroupLimit before the shuffle, so a hot group is cut to n ranks on the
  map side.

Ties: the reference sorts without a tie-breaker, so equal values could come
back in any order; callers pass key columns that make the order total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n is not None else ordered


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "drnk",
    dense: bool = True,
    keep_rank: bool = True,
) -> DataFrame:
    rank_fn = F.dense_rank() if dense else F.rank()
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank_col, rank_fn.over(w)).filter(F.col(rank_col) <= n)
    return ranked if keep_rank else ranked.drop(rank_col)
