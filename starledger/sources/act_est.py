"""Actual and forecast quantities joined into one fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.functions.dates import fiscal_year

ACT_EST_KEYS = ["date", "product_code", "customer_code"]


def integrate_act_est(fact_sales: DataFrame, fact_forecast: DataFrame) -> DataFrame:
    """Every (month, product, customer) with sales or a forecast; gaps are 0. One full outer join."""
    s = fact_sales.select(*ACT_EST_KEYS, "sold_quantity")
    f = fact_forecast.select(*ACT_EST_KEYS, "forecast_quantity")
    quantities = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("sold_quantity", "forecast_quantity")]
    return s.join(f, ACT_EST_KEYS, "full").select("date", fiscal_year("date").alias("fiscal_year"), "product_code", "customer_code", *quantities)
