"""Registry entries for the streaming jobs: each streams both facts, as change feeds, into an empty
table, one in either order. Both final states equal the batch rebuild ``act_est_build``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starledger.sources.star import star_for
from starledger.streaming.upsert import replay


def act_est_upsert_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star_for(spark, sf_dir)
    return replay(spark, [(m.fact_forecast_monthly, "forecast_quantity"), (m.fact_sales_monthly, "sold_quantity")])


def act_est_upsert_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = star_for(spark, sf_dir)
    return replay(spark, [(m.fact_sales_monthly, "sold_quantity"), (m.fact_forecast_monthly, "forecast_quantity")])


STREAM_REPORTS = {
    "act_est_upsert_actuals": act_est_upsert_actuals,
    "act_est_upsert_forecast": act_est_upsert_forecast,
}
