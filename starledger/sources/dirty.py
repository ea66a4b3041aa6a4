"""Deliberately damaged copies of the star tables for the data-quality reports.

The driver tables have no NULLs and a unique grain, so the audits would return
nothing. These variants inject NULLs and duplicate rows by fixed key rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.sources.star import SalesModel


def _null_where(col: str, cond) -> F.Column:
    return F.when(cond, F.lit(None).cast("string")).otherwise(F.col(col)).alias(col)


def dirty_dim_customer(dim_customer: DataFrame) -> DataFrame:
    k = F.col("customer_code")
    damaged = dim_customer.select(
        "customer_code", "customer",
        _null_where("platform", k % 17 == 0),
        "channel", "market",
        _null_where("sub_zone", k % 29 == 0),
        "region",
    )
    return damaged.unionByName(dim_customer.filter(k % 50 == 0))


def dirty_dim_product(dim_product: DataFrame) -> DataFrame:
    k = F.col("product_code")
    damaged = dim_product.select(
        "product_code", "division", "segment", "category", "product", _null_where("variant", k % 13 == 0)
    )
    return damaged.unionByName(dim_product.filter(k % 40 == 0))


def dirty_fact_sales(fact_sales: DataFrame) -> DataFrame:
    k = F.col("product_code") + F.col("customer_code")
    damaged = fact_sales.select(
        "date", "fiscal_year", "product_code", "customer_code",
        F.when(k % 97 == 0, F.lit(None).cast("int")).otherwise(F.col("sold_quantity")).alias("sold_quantity"),
    )
    return damaged.unionByName(fact_sales.filter(k % 101 == 0))


def inconsistent_star(m: SalesModel) -> SalesModel:
    """Dimensions and prices in which a key carries several values: other spellings, a moved market, two prices."""
    c, p, g = m.dim_customer, m.dim_product, m.fact_gross_price
    respelt = c.where("customer_code % 40 = 0").withColumn("customer", F.concat("customer", F.lit(" Ltd")))
    moved = c.where("customer_code % 90 = 0").withColumn("region", F.lit("ELSEWHERE"))
    unzoned = c.where("customer_code % 110 = 0").withColumn("sub_zone", F.lit(None).cast("string"))
    shifted = p.where("product_code % 30 = 0").withColumn("division", F.concat(F.lit("NEW "), "division"))
    repriced = g.where("product_code % 25 = 0 and fiscal_year % 2 = 0").withColumn("gross_price", F.col("gross_price") + F.lit(1).cast("decimal(9,4)")).select(g.columns)
    repriced = repriced.withColumn("gross_price", F.col("gross_price").cast("decimal(9,4)"))
    return m.replace(dim_customer=c.unionByName(respelt).unionByName(moved).unionByName(unzoned), dim_product=p.unionByName(shifted), fact_gross_price=g.unionByName(repriced))


def star_with_gaps(m: SalesModel) -> SalesModel:
    """Parents that are missing: customers, products, a month, prices and discounts of some years; null keys in sales."""
    s = m.fact_sales_monthly
    gone = (F.col("product_code") + F.col("customer_code")) % 499 == 0
    s = s.select("date", "fiscal_year", "product_code", F.when(gone, F.lit(None).cast("long")).otherwise(F.col("customer_code")).alias("customer_code"), "sold_quantity")
    return m.replace(
        fact_sales_monthly=s,
        dim_customer=m.dim_customer.where("customer_code % 61 <> 0"),
        dim_product=m.dim_product.where("product_code % 53 <> 0"),
        dim_date=m.dim_date.where("calendar_date <> DATE'1996-03-01'"),
        fact_gross_price=m.fact_gross_price.where("(product_code + fiscal_year) % 97 <> 0"),
        fact_pre_invoice_deductions=m.fact_pre_invoice_deductions.where("(customer_code + fiscal_year) % 89 <> 0"),
        fact_post_invoice_deductions=m.fact_post_invoice_deductions.where("(customer_code + product_code) % 211 <> 0"),
    )
