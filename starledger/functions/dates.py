"""Fiscal calendar expressions.

The fiscal year starts in September: a date belongs to fiscal year
``year(date + 4 months)``. Filters on a fiscal year are better written as a
date range, because a range on the raw date column is pushed into the Parquet
scan (row-group statistics) while ``year(add_months(date, 4)) = fy`` is not.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from starledger.constants import FISCAL_YEAR_SHIFT_MONTHS

FISCAL_SHIFT_MONTHS = FISCAL_YEAR_SHIFT_MONTHS


def fiscal_year(date_col: Column | str, shift_months: int = FISCAL_SHIFT_MONTHS) -> Column:
    """Fiscal year of a date/timestamp column as INT (``year(add_months(d, shift))``)."""
    col = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.year(F.add_months(col.cast("date"), shift_months)).cast("int")


def fiscal_year_bounds(fy: int, shift_months: int = FISCAL_SHIFT_MONTHS) -> tuple[_dt.date, _dt.date]:
    """Half-open date range ``[start, end)`` covered by fiscal year ``fy``."""
    start_month = 13 - shift_months  # 9 = September for a 4-month shift
    if start_month > 12:
        return _dt.date(fy, 1, 1), _dt.date(fy + 1, 1, 1)
    return _dt.date(fy - 1, start_month, 1), _dt.date(fy, start_month, 1)


def in_fiscal_year(date_col: Column | str, fy: int, shift_months: int = FISCAL_SHIFT_MONTHS) -> Column:
    """``fiscal_year(date) == fy`` rewritten as a pushable date range."""
    col = F.col(date_col) if isinstance(date_col, str) else date_col
    lo, hi = fiscal_year_bounds(fy, shift_months)
    return (col >= F.lit(lo)) & (col < F.lit(hi))
