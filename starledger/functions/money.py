"""Money and ratio expressions with exact decimal semantics.

Money stays DECIMAL through every sum; outputs are cast to DOUBLE only at the
end. Rounded ratios are computed exactly on integers (half away from zero), so
results do not depend on floating-point summation order or on how an engine
rounds a binary double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revenue(qty: Column | str = "sold_quantity", price: Column | str = "gross_price") -> Column:
    """Exact line revenue ``qty * price`` (INT x DECIMAL(9,4) -> DECIMAL(20,4))."""
    return _c(qty) * _c(price)


def gross_line_total(qty: Column | str = "sold_quantity", price: Column | str = "gross_price") -> Column:
    """``ROUND(qty * price, 2)`` kept as DECIMAL(16,2)."""
    return F.round(revenue(qty, price), 2).cast("decimal(16,2)")


def scaled(x: Column | str, scale: int) -> Column:
    """A decimal with at most ``scale`` fractional digits as the exact integer x * 10^scale."""
    return (_c(x).cast("decimal(38,%d)" % scale) * F.lit(10**scale)).cast("decimal(38,0)")


def mln_units(total: Column | str) -> Column:
    """``ROUND(total / 1e6, 2)`` as an exact integer count of 0.01 million.

    ``total`` must be DECIMAL (cast integer sums to DECIMAL(38,0) first)."""
    return (F.round(_c(total), -4) / F.lit(10_000)).cast("decimal(38,0)")


def mln(total: Column | str) -> Column:
    """``ROUND(total / 1e6, 2)`` as DOUBLE (rounded exactly, converted once)."""
    return mln_units(total).cast("double") / F.lit(100.0)


def int_div(a: Column, b: Column) -> Column:
    """Exact truncating division of non-negative integer-valued decimals (``a div b``)."""
    a = a.cast("decimal(38,0)")
    b = b.cast("decimal(38,0)")
    return ((a - a % b) / b).cast("decimal(38,0)")


def exact_round_units(num: Column | str, den: Column | str, digits: int) -> Column:
    """``ROUND(num / den, digits) * 10^digits`` as an exact signed integer (DECIMAL(38,0)).

    ``num`` and ``den`` must be integer-valued; rounding is half away from zero;
    NULL when ``den`` is 0 or NULL (MySQL's division-by-zero result).
    """
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    p = 10**digits
    magnitude = int_div(F.abs(n) * F.lit(2 * p) + F.abs(d), F.abs(d) * F.lit(2))
    signed = (magnitude * F.signum(n).cast("int") * F.signum(d).cast("int")).cast("decimal(38,0)")
    return F.when(d == 0, F.lit(None).cast("decimal(38,0)")).otherwise(signed)


def exact_round_ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """``ROUND(num / den, digits)`` computed exactly, returned as DOUBLE."""
    return exact_round_units(num, den, digits).cast("double") / F.lit(float(10**digits))


def double_ratio(num: Column | str, den: Column | str, times: int = 1) -> Column:
    """``num * times / den`` in DOUBLE (both sides converted from exact values once);
    NULL when ``den`` is 0."""
    n = (_c(num) * F.lit(times)) if times != 1 else _c(num)
    return F.try_divide(n.cast("double"), _c(den).cast("double"))


def to_double(x: Column | str) -> Column:
    return _c(x).cast("double")


def distinct_count(col: Column | str, exact: bool = True, rsd: float = 0.01) -> Column:
    """COUNT(DISTINCT col); with ``exact=False`` a HyperLogLog++ estimate (bounded memory
    per group, mergeable partial aggregates) with relative standard deviation ``rsd``."""
    return F.count_distinct(_c(col)) if exact else F.approx_count_distinct(_c(col), rsd)
