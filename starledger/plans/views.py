"""The revenue waterfall as composable, lazy views over a ``SalesModel``.

gross_sales            sales + product + customer + gross price, line total
sales_preinv_discount  + pre-invoice discount (customer, fiscal year)
sales_postinv_discount + net invoice sales, post-invoice discount (customer, product, month)
net_sales              + net sales

Joins are declared; the physical strategy is left to Catalyst/AQE (broadcast
when a side's measured size is under the threshold, sort-merge otherwise).
A fiscal-year filter on the result is pushed to the fact scan and, through
the join keys, inferred for the price and deduction facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.dates import in_fiscal_year
from starledger.functions.money import gross_line_total, revenue
from starledger.functions.text import same_text
from starledger.sources.star import MARKET_COLUMN, PAIR_KEYS, SalesModel


def _sales(m: SalesModel, fiscal_year: int | None = None, layout: DataFrame | None = None) -> DataFrame:
    s = (m.fact_sales_monthly if layout is None else layout).select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    if fiscal_year is None:
        return s
    # The stored fiscal_year prunes partitions; the equivalent date range is inferred
    # through the ``date`` join key and prunes the month-partitioned deductions.
    return s.filter((F.col("fiscal_year") == fiscal_year) & in_fiscal_year("date", fiscal_year))


def _price(m: SalesModel) -> DataFrame:
    return m.fact_gross_price.select("product_code", "fiscal_year", "gross_price")


def _products(m: SalesModel) -> DataFrame:
    """Price list with product names, per (product, fiscal year)."""
    return _price(m).join(m.dim_product.select("product_code", "product", "variant"), "product_code")


def priced_sales(m: SalesModel) -> DataFrame:
    """Sales of known products with their price."""
    priced = _price(m).join(m.dim_product.select("product_code"), "product_code")
    return _sales(m).join(priced, ["product_code", "fiscal_year"])


def _discounts(m: SalesModel, *columns: str) -> DataFrame:
    """Pre-invoice discounts with customer columns, per (customer, fiscal year)."""
    pre = m.fact_pre_invoice_deductions.select("customer_code", "fiscal_year", "pre_invoice_discount_pct")
    return pre.join(m.dim_customer.select("customer_code", "market", *columns), "customer_code")


def gross_sales(m: SalesModel, fiscal_year: int | None = None, *columns: str) -> DataFrame:
    """``columns``: further customer columns to carry."""
    c = m.dim_customer.select("customer_code", "customer", "market", *columns)
    return (
        _sales(m, fiscal_year)
        .join(_products(m), ["product_code", "fiscal_year"])
        .join(c, "customer_code")
        .select(
            "date", "fiscal_year", "customer_code", "customer", "market", "product_code", "product", "variant",
            "sold_quantity",
            F.col("gross_price").alias("gross_price_per_item"),
            gross_line_total("sold_quantity", "gross_price").alias("gross_price_total"),
            *columns,
        )
    )


def sales_preinv_discount(m: SalesModel, fiscal_year: int | None = None, *columns: str) -> DataFrame:
    """``columns``: further customer columns to carry. The small sides are joined with each other
    first (customers with discounts, products with prices), so the fact meets two tables, not four."""
    return _with_discounts(_sales(m, fiscal_year), m, *columns).select(
        "date", "fiscal_year", "customer_code", "market", "product_code", "product", "variant", "sold_quantity",
        F.col("gross_price").alias("gross_price_per_item"),
        "gross_price_total",
        "pre_invoice_discount_pct",
        *columns,
    )


def _with_discounts(sales: DataFrame, m: SalesModel, *columns: str) -> DataFrame:
    joined = sales.join(_products(m), ["product_code", "fiscal_year"]).join(_discounts(m, *columns), ["customer_code", "fiscal_year"])
    return joined.withColumn("gross_price_total", gross_line_total("sold_quantity", "gross_price"))


def _sales_with_deductions(m: SalesModel, fiscal_year: int | None) -> DataFrame:
    """Sales and post-invoice deductions by their three keys. A stored star holds both bucketed and sorted
    by them, so neither is exchanged."""
    deductions = ["customer_code", "product_code", "date", "discounts_pct", "other_deductions_pct"]
    if m.sales_by_key is None or m.post_by_key is None:
        return _sales(m, fiscal_year).join(m.fact_post_invoice_deductions.select(deductions), list(PAIR_KEYS))
    po = m.post_by_key if fiscal_year is None else m.post_by_key.filter(F.col("fiscal_year") == fiscal_year)
    return _sales(m, fiscal_year, m.sales_by_key).join(po.select(deductions), list(PAIR_KEYS))


def sales_postinv_discount(m: SalesModel, fiscal_year: int | None = None, *columns: str) -> DataFrame:
    """The two facts meet first, then the small sides (see ``sales_preinv_discount``)."""
    s = _with_discounts(_sales_with_deductions(m, fiscal_year), m, *columns)
    return s.select(
        "date", "fiscal_year", "customer_code", "market", "product_code", "product", "variant",
        "sold_quantity", "gross_price_total", "pre_invoice_discount_pct",
        ((F.lit(1) - F.col("pre_invoice_discount_pct")) * F.col("gross_price_total")).alias("net_invoice_sales"),
        (F.col("discounts_pct") + F.col("other_deductions_pct")).alias("post_invoice_discount_pct"),
        *columns,
    )


def net_sales(m: SalesModel, fiscal_year: int | None = None, *columns: str) -> DataFrame:
    s = sales_postinv_discount(m, fiscal_year, *columns)
    return s.select("*", (F.col("net_invoice_sales") * (F.lit(1) - F.col("post_invoice_discount_pct"))).alias("net_sales"))


def revenue_star(m: SalesModel, market: str | None = None, with_product: bool = True, with_price: bool = True, ignore_case: bool = False) -> DataFrame:
    """Sales x customer (x product) (x price): the input of the market reports.

    ``rev`` is the exact unrounded ``sold_quantity * gross_price``. The product
    and price joins are inner joins, as in the reference, so they drop sales of
    unknown products or without a price; each report keeps exactly the joins
    its reference query has.
    """
    s = _sales(m)
    c = m.dim_customer
    if market is not None and not ignore_case and m.sales_by_market is not None:
        # The layout holds each row's market: files and row groups of other markets aren't read.
        s = _sales(m, layout=m.sales_by_market.filter(F.col(MARKET_COLUMN) == market))
    if market is not None:
        c = c.filter(same_text("market", market, ignore_case))
    star = s.join(c, "customer_code")
    if with_product:
        star = star.join(m.dim_product, "product_code")
    if with_price:
        star = star.join(_price(m), ["product_code", "fiscal_year"]).withColumn("rev", revenue("sold_quantity", "gross_price"))
    return star
