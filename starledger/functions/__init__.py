"""Native column expressions (never Python UDFs): dates, money, exact rounding."""

from starledger.functions.dates import fiscal_year, fiscal_year_bounds, in_fiscal_year
from starledger.functions.money import (
    distinct_count,
    double_ratio,
    exact_round_ratio,
    exact_round_units,
    int_div,
    gross_line_total,
    mln,
    mln_units,
    revenue,
    scaled,
    to_double,
)

__all__ = [
    "fiscal_year",
    "fiscal_year_bounds",
    "in_fiscal_year",
    "gross_line_total",
    "revenue",
    "mln",
    "mln_units",
    "scaled",
    "distinct_count",
    "exact_round_ratio",
    "exact_round_units",
    "double_ratio",
    "int_div",
    "to_double",
]
