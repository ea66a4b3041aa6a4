"""A. Data-quality reports over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from starledger.operators.audits import Dependency, Edge, dependency_violations, orphans
from starledger.operators.quality import duplicate_keys, fill_missing, null_rows

from starledger.sources.star import SalesModel

CUSTOMER_COLS = ["customer_code", "customer", "platform", "channel", "market", "sub_zone", "region"]
PRODUCT_COLS = ["product_code", "division", "segment", "category", "product", "variant"]
SALES_COLS = ["date", "fiscal_year", "product_code", "customer_code", "sold_quantity"]


def dq_null_customers(dim_customer: DataFrame) -> DataFrame:
    return null_rows(dim_customer.select(CUSTOMER_COLS), CUSTOMER_COLS)


def dq_fill_customers(dim_customer: DataFrame) -> DataFrame:
    return fill_missing(dim_customer.select(CUSTOMER_COLS), CUSTOMER_COLS[1:])


def dq_dup_customers(dim_customer: DataFrame) -> DataFrame:
    return duplicate_keys(dim_customer, ["customer_code", "customer"])


def dq_null_products(dim_product: DataFrame) -> DataFrame:
    return null_rows(dim_product.select(PRODUCT_COLS), PRODUCT_COLS)


def dq_fill_products(dim_product: DataFrame) -> DataFrame:
    return fill_missing(dim_product.select(PRODUCT_COLS), PRODUCT_COLS[1:])


def dq_dup_products(dim_product: DataFrame) -> DataFrame:
    return duplicate_keys(dim_product, ["product_code", "product"])


def dq_null_sales(fact_sales: DataFrame) -> DataFrame:
    return null_rows(fact_sales.select(SALES_COLS), SALES_COLS)


def dq_dup_sales(fact_sales: DataFrame) -> DataFrame:
    return duplicate_keys(fact_sales, SALES_COLS[:4])


def dq_dependencies(m: SalesModel) -> DataFrame:
    """Where a relaxed GROUP BY would carry an undetermined column: keys with several carried values.

    The reference groups by a code or a name and selects columns beside it; that is right only if the key
    determines them. All pairs of all tables are checked in one aggregate.
    """
    rules = [Dependency(f"customer_code -> {c}", m.dim_customer, ("customer_code",), c) for c in CUSTOMER_COLS[1:]]
    rules += [Dependency(f"product_code -> {c}", m.dim_product, ("product_code",), c) for c in PRODUCT_COLS[1:]]
    rules += [
        Dependency("product -> division", m.dim_product, ("product",), "division"),
        Dependency("sub_zone -> region", m.dim_customer, ("sub_zone",), "region"),
        Dependency("market -> region", m.dim_customer, ("market",), "region"),
        Dependency("date -> fiscal_year", m.dim_date, ("calendar_date",), "fiscal_year"),
        Dependency("product_code, fiscal_year -> gross_price", m.fact_gross_price, ("product_code", "fiscal_year"), "gross_price"),
        Dependency("customer_code, fiscal_year -> pre_invoice_discount_pct", m.fact_pre_invoice_deductions, ("customer_code", "fiscal_year"), "pre_invoice_discount_pct"),
    ]
    return dependency_violations(rules)


def dq_orphans(m: SalesModel) -> DataFrame:
    """Rows that the inner joins of the waterfall and of the forecast reports drop, by foreign key."""
    sales, forecast, post = m.fact_sales_monthly, m.fact_forecast_monthly, m.fact_post_invoice_deductions
    return orphans(
        [
            Edge("sales -> customer", sales, m.dim_customer, ("customer_code",)),
            Edge("sales -> product", sales, m.dim_product, ("product_code",)),
            Edge("sales -> date", sales, m.dim_date, ("date",), ("calendar_date",)),
            Edge("sales -> gross price", sales, m.fact_gross_price, ("product_code", "fiscal_year")),
            Edge("sales -> pre-invoice discount", sales, m.fact_pre_invoice_deductions, ("customer_code", "fiscal_year")),
            Edge("sales -> post-invoice deductions", sales, post, ("customer_code", "product_code", "date")),
            Edge("forecast -> customer", forecast, m.dim_customer, ("customer_code",)),
            Edge("forecast -> product", forecast, m.dim_product, ("product_code",)),
            Edge("gross price -> product", m.fact_gross_price, m.dim_product, ("product_code",)),
            Edge("pre-invoice discount -> customer", m.fact_pre_invoice_deductions, m.dim_customer, ("customer_code",)),
        ]
    )
