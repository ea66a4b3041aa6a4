"""The reference's stored procedures and function under their own names.

For users switching over: each call returns a DataFrame (a procedure's result
set) computed by the report functions of ``starledger.plans``; the model
argument replaces the database connection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from starledger.constants import DEFAULT_MARKET
from starledger.functions.dates import fiscal_year
from starledger.plans import finance, revenue, supply
from starledger.sources.star import SalesModel


def get_fiscal_year(calendar_date: Column | str) -> Column:
    return fiscal_year(calendar_date)


def get_monthly_gross_sales_for_customer(m: SalesModel, in_customer_codes: str | Sequence[int]) -> DataFrame:
    return finance.monthly_gross_sales_customers(m, in_customer_codes)


def get_market_badge(m: SalesModel, in_market: str, in_fiscal_year: int, threshold: int | None = None) -> DataFrame:
    """One row with the market's quantity and ``badge`` (the procedure's OUT value)."""
    kwargs = {} if threshold is None else {"threshold": threshold}
    return finance.market_badge(m, in_fiscal_year, in_market or DEFAULT_MARKET, **kwargs)


def get_top_n_markets_by_net_sales(m: SalesModel, in_fiscal_year: int, in_top_n: int) -> DataFrame:
    return revenue.top_n_markets_net_sales(m, in_fiscal_year, in_top_n)


def get_top_n_customers_by_net_sales(m: SalesModel, in_market: str, in_fiscal_year: int, in_top_n: int) -> DataFrame:
    return revenue.top_n_customers_net_sales(m, in_market, in_fiscal_year, in_top_n)


def get_top_n_products_per_division_by_qty_sold(m: SalesModel, in_fiscal_year: int, in_top_n: int) -> DataFrame:
    return revenue.top_n_products_per_division(m, in_fiscal_year, in_top_n)


def get_top_n_products_by_net_sales(m: SalesModel, in_fiscal_year: int, in_top_n: int) -> DataFrame:
    return revenue.top_n_products_net_sales(m, in_fiscal_year, in_top_n)


def get_forecast_accuracy(m: SalesModel, in_fiscal_year: int) -> DataFrame:
    return supply.forecast_accuracy(supply.act_est(m, [in_fiscal_year]), m.dim_customer, in_fiscal_year)
