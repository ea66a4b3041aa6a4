"""Text comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(column: str, value: str, ignore_case: bool = False) -> Column:
    """Whether ``column`` is ``value``; ``ignore_case`` compares as a case-insensitive collation does."""
    left = F.collate(F.col(column), "UTF8_LCASE") if ignore_case else F.col(column)
    return left == F.lit(value)
