"""H. Headline queries: market revenue, value segments, top products, forecast ratio, trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.constants import HIGH_VALUE_REVENUE, MEDIUM_VALUE_REVENUE, SEGMENT_HIGH, SEGMENT_LOW, SEGMENT_MEDIUM

from starledger.functions.money import exact_round_ratio, mln_units
from starledger.operators.ranking import top_n
from starledger.plans.views import revenue_star
from starledger.sources.star import SalesModel


def _units_to_mln(col: str = "_u") -> F.Column:
    return F.col(col).cast("double") / F.lit(100.0)


def gross_revenue_top_markets(m: SalesModel, n: int = 10) -> DataFrame:
    """Gross revenue (quantity x gross price) in millions per market, top n."""
    agg = revenue_star(m, with_product=False).groupBy("market").agg(mln_units(F.sum("rev")).alias("_u"))
    return top_n(agg, [F.col("_u").desc(), "market"], n).select("market", _units_to_mln().alias("gross_revenue_mln"))


def customer_value_segments(m: SalesModel, high: int = HIGH_VALUE_REVENUE, medium: int = MEDIUM_VALUE_REVENUE) -> DataFrame:
    agg = revenue_star(m, with_product=False).groupBy("customer_code", "customer").agg(F.sum("rev").alias("_rev"))
    rev = F.col("_rev")
    segment = (
        F.when(rev >= high, F.lit(SEGMENT_HIGH))
        .when(rev.between(medium, high), F.lit(SEGMENT_MEDIUM))
        .otherwise(F.lit(SEGMENT_LOW))
    )
    return agg.select("customer", rev.cast("double").alias("total_revenue"), segment.alias("customer_segment"), "customer_code").orderBy(
        F.col("total_revenue").desc(), "customer_code"
    ).drop("customer_code")


def top_products_quantity(m: SalesModel, n: int = 10) -> DataFrame:
    s = m.fact_sales_monthly.select("product_code", "sold_quantity")
    agg = s.join(m.dim_product.select("product_code", "product"), "product_code").groupBy("product").agg(
        mln_units(F.sum("sold_quantity").cast("decimal(38,0)")).alias("_u")
    )
    return top_n(agg, [F.col("_u").desc(), "product"], n).select("product", _units_to_mln().alias("qty_sold_mln"))


def fm_top_customers_platform(m: SalesModel, market: str, n: int = 10) -> DataFrame:
    agg = revenue_star(m, market, with_product=False).groupBy("customer", "platform").agg(mln_units(F.sum("rev")).alias("_u"))
    return top_n(agg, [F.col("_u").desc(), "customer", "platform"], n).select(
        "customer", _units_to_mln().alias("revenue_mln"), "platform"
    )


def forecast_to_sales_ratio(
    m: SalesModel, n: int = 10, keys: Sequence[str] = ("product_code", "fiscal_year", "date")
) -> DataFrame:
    """100 x SUM(forecast) / SUM(sold) per customer name, the n lowest.

    The reference joins forecast rows on (product, fiscal year, month) only, so
    every sales row meets every forecast row of its product-month. Instead of
    materialising that fan-out, the forecast is pre-aggregated to
    ``(SUM(forecast), COUNT(*))`` per key: each sales row then contributes the
    key's forecast sum and ``sold x count`` — the same sums, linear in the data.
    Pass ``keys`` with ``customer_code`` for the keyed (per-customer) variant.
    """
    keys = list(keys)
    f = m.fact_forecast_monthly.groupBy(*keys).agg(
        F.sum("forecast_quantity").alias("_f"), F.count(F.lit(1)).alias("_fn")
    )
    cols = keys + [c for c in ("customer_code",) if c not in keys]
    s = m.fact_sales_monthly.select(*cols, "sold_quantity")
    c = m.dim_customer.select("customer_code", "customer")
    agg = s.join(f, keys).join(c, "customer_code").groupBy("customer").agg(
        F.sum("_f").alias("_sf"), F.sum(F.col("sold_quantity") * F.col("_fn")).alias("_ss")
    )
    out = agg.select("customer", exact_round_ratio(F.col("_sf") * 100, "_ss", 2).alias("forecast_accuracy_pct"))
    return top_n(out, [F.col("forecast_accuracy_pct").asc_nulls_first(), "customer"], n)


def revenue_trend_market_vs_rest(m: SalesModel, market: str) -> DataFrame:
    star = revenue_star(m, with_product=False)
    zero = F.lit(0)
    agg = star.groupBy("fiscal_year").agg(
        F.sum(F.when(F.col("market") == market, F.col("rev")).otherwise(zero)).alias("_in"),
        F.sum(F.when(F.col("market") != market, F.col("rev")).otherwise(zero)).alias("_out"),
    )
    return agg.select(
        "fiscal_year", F.col("_in").cast("double").alias("market_revenue"), F.col("_out").cast("double").alias("other_revenue")
    ).orderBy("fiscal_year")
