"""Share-of-total operators without single-partition windows.

``SUM(x) OVER ()`` moves every row into one task. Instead the total is a
scalar subquery (computed once, a one-row aggregate with map-side partial
sums), and per-group totals are an aggregate joined back on the group key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grand_total(df: DataFrame, value: str) -> Column:
    """``(SELECT SUM(value) FROM df)`` as a scalar-subquery column."""
    return df.agg(F.sum(value)).scalar()


def with_group_total(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Attach ``SUM(value) OVER (PARTITION BY by)`` as column ``out`` via aggregate + join.

    The per-group totals have one row per group; AQE broadcasts them when
    their runtime size is under the broadcast threshold, else it shuffles.
    """
    totals = df.groupBy(*by).agg(F.sum(value).alias(out))
    return df.join(totals, list(by))
