"""B. Financial reports: fiscal year, customer transactions, gross sales, market badge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.constants import BADGE_GOLD, BADGE_SILVER, DEFAULT_BADGE_THRESHOLD, DEFAULT_MARKET

from starledger.functions.dates import fiscal_year, in_fiscal_year
from starledger.functions.money import gross_line_total
from starledger.functions.text import same_text
from starledger.sources.star import SalesModel


def fiscal_year_of_date(orders: DataFrame) -> DataFrame:
    """The fiscal-year function applied to every order date."""
    d = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", d.alias("order_date"), fiscal_year(d).alias("fiscal_year"))


def _customer_year(m: SalesModel, customer_code: int, fy: int) -> DataFrame:
    s = m.fact_sales_monthly.select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    return s.filter((F.col("customer_code") == customer_code) & _in_year(fy))


def _in_year(fy: int) -> F.Column:
    """``fiscal_year(date) = fy`` as a date range (pushed into the Parquet scan) plus the
    equal ``fiscal_year`` column test (directory pruning on a stored, partitioned star)."""
    return in_fiscal_year("date", fy) & (F.col("fiscal_year") == fy)


def customer_fy_transactions(m: SalesModel, customer_code: int, fy: int) -> DataFrame:
    return _customer_year(m, customer_code, fy).orderBy("date", "product_code")


def customer_fy_with_product(m: SalesModel, customer_code: int, fy: int) -> DataFrame:
    s = _customer_year(m, customer_code, fy)
    p = m.dim_product.select("product_code", "product", "variant")
    return s.join(p, "product_code").select("date", "product_code", "product", "variant", "sold_quantity")


def customer_fy_with_gross_price(m: SalesModel, customer_code: int, fy: int) -> DataFrame:
    s = _customer_year(m, customer_code, fy)
    p = m.dim_product.select("product_code", "product", "variant")
    g = m.fact_gross_price.select("product_code", "fiscal_year", "gross_price")
    return s.join(p, "product_code").join(g, ["product_code", "fiscal_year"]).select(
        "date", "product_code", "product", "variant", "sold_quantity",
        F.col("gross_price").cast("double").alias("gross_price"),
        gross_line_total().cast("double").alias("gross_price_total"),
    )


def _priced(m: SalesModel, customers: Sequence[int]) -> DataFrame:
    s = m.fact_sales_monthly.select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    s = s.filter(F.col("customer_code").isin(list(customers)))
    g = m.fact_gross_price.select("product_code", "fiscal_year", "gross_price")
    return s.join(g, ["product_code", "fiscal_year"]).withColumn("line_total", gross_line_total())


def monthly_gross_sales_customer(m: SalesModel, customer_code: int) -> DataFrame:
    return (
        _priced(m, [customer_code])
        .groupBy("date", "fiscal_year")
        .agg(F.sum("line_total").cast("double").alias("monthly_sales"))
    )


def monthly_gross_sales_customers(m: SalesModel, customer_codes: Sequence[int] | str) -> DataFrame:
    """Monthly gross sales for several customers; ``customer_codes`` may also be the
    procedure's comma-separated text (``"101,102"``)."""
    if isinstance(customer_codes, str):
        customer_codes = [int(c) for c in customer_codes.split(",") if c.strip()]
    return (
        _priced(m, customer_codes)
        .groupBy("date")
        .agg(F.sum("line_total").cast("double").alias("gross_price_total"))
        .orderBy(F.col("date").desc())
    )


def market_badge(m: SalesModel, fy: int, market: str = DEFAULT_MARKET, threshold: int = DEFAULT_BADGE_THRESHOLD, ignore_case: bool = False) -> DataFrame:
    """Gold when the market's fiscal-year quantity exceeds ``threshold``, else Silver
    (also Silver when the market sold nothing). One row."""
    s = m.fact_sales_monthly.select("customer_code", "date", "fiscal_year", "sold_quantity").filter(_in_year(fy))
    market = market or DEFAULT_MARKET  # an empty market means the default one
    c = m.dim_customer.select("customer_code", "market").filter(same_text("market", market, ignore_case))
    qty = s.join(c, "customer_code").agg(F.sum("sold_quantity").alias("total_qty"))
    return qty.select(
        F.lit(market).alias("market"),
        F.lit(fy).alias("fiscal_year"),
        "total_qty",
        F.when(F.col("total_qty") > threshold, F.lit(BADGE_GOLD)).otherwise(F.lit(BADGE_SILVER)).alias("badge"),
    )


def market_badges(m: SalesModel, fy: int, threshold: int = DEFAULT_BADGE_THRESHOLD) -> DataFrame:
    """Badge for every market in one aggregation."""
    s = m.fact_sales_monthly.select("customer_code", "date", "fiscal_year", "sold_quantity").filter(_in_year(fy))
    c = m.dim_customer.select("customer_code", "market")
    return s.join(c, "customer_code").groupBy("market").agg(F.sum("sold_quantity").alias("total_qty")).select(
        "market", F.lit(fy).alias("fiscal_year"), "total_qty",
        F.when(F.col("total_qty") > threshold, F.lit(BADGE_GOLD)).otherwise(F.lit(BADGE_SILVER)).alias("badge"),
    )


def yearly_gross_sales_customer(m: SalesModel, customer_code: int) -> DataFrame:
    return (
        _priced(m, [customer_code])
        .groupBy(fiscal_year("date").alias("fiscal_year"))
        .agg(F.sum("line_total").cast("double").alias("yearly_sales"))
        .orderBy("fiscal_year")
    )
