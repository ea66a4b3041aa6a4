"""Data-quality audits: NULL rows, NULL filling, duplicate keys."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.constants import MISSING_LABEL


def null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with a NULL in any of ``cols`` (all columns by default): one filter, no shuffle."""
    cols = list(cols or df.columns)
    return df.filter(functools.reduce(operator.or_, [F.col(c).isNull() for c in cols]))


def fill_missing(df: DataFrame, cols: Sequence[str], value: str = MISSING_LABEL) -> DataFrame:
    """``COALESCE(col, value)`` for ``cols``; other columns unchanged."""
    return df.fillna(value, subset=list(cols))


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_col: str = "row_count") -> DataFrame:
    """Keys occurring more than once, with their count.

    ``count`` is combinable, so a hot key collapses in the map-side partial
    aggregate before the shuffle.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col)).filter(F.col(count_col) > 1)
