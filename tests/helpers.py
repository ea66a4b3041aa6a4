"""Build a SalesModel from literal rows for unit tests."""

import datetime as dt
from decimal import Decimal

from starledger.functions.dates import fiscal_year
from starledger.sources.star import SalesModel

D = dt.date


def model(spark, customers, products, sales, prices, forecasts=(), pre=(), post=()):
    """customers: (code, name, platform, channel, market, sub_zone, region)
    products: (code, division, segment, category, product, variant)
    sales: (date, product_code, customer_code, qty); prices: (product_code, fy, price)
    forecasts: (date, product_code, customer_code, qty)"""
    dc = spark.createDataFrame(customers, "customer_code long, customer string, platform string, channel string, market string, sub_zone string, region string")
    dp = spark.createDataFrame(products, "product_code long, division string, segment string, category string, product string, variant string")
    s = spark.createDataFrame(sales, "date date, product_code long, customer_code long, sold_quantity int")
    s = s.select("date", fiscal_year("date").alias("fiscal_year"), "product_code", "customer_code", "sold_quantity")
    g = spark.createDataFrame([(p, y, Decimal(str(v))) for p, y, v in prices], "product_code long, fiscal_year int, gross_price decimal(9,4)")
    f = spark.createDataFrame(list(forecasts), "date date, product_code long, customer_code long, forecast_quantity int")
    f = f.select("date", fiscal_year("date").alias("fiscal_year"), "product_code", "customer_code", "forecast_quantity")
    pre_df = spark.createDataFrame([(c, y, Decimal(str(v))) for c, y, v in pre], "customer_code long, fiscal_year int, pre_invoice_discount_pct decimal(5,4)")
    post_df = spark.createDataFrame(
        [(c, p, d, Decimal(str(a)), Decimal(str(b))) for c, p, d, a, b in post],
        "customer_code long, product_code long, date date, discounts_pct decimal(5,4), other_deductions_pct decimal(5,4)",
    )
    dd = s.select("date", "fiscal_year").distinct().withColumnRenamed("date", "calendar_date")
    return SalesModel(dc, dp, dd, s, g, pre_df, post_df, f)
