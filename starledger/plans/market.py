"""E. Focus-market deep dive and F. comparative market reports.

The focus market is a parameter (one market against the rest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.constants import OTHER_MARKETS

from starledger.functions.money import distinct_count, exact_round_ratio, scaled
from starledger.operators.ranking import top_n, top_n_per_group
from starledger.operators.shares import grand_total
from starledger.plans.summary import by_group, distinct_days, market_months
from starledger.plans.views import revenue_star
from starledger.session import cut_lineage
from starledger.sources.star import SalesModel


def _rev_total() -> Column:
    return F.sum("rev").alias("_rev")


def _avg_rounded(sum_col: str, count_col: Column) -> Column:
    """ROUND(AVG(rev), 2) exactly: rev has 4 decimals, so avg = sum*10^4 / (count*10^4)."""
    return exact_round_ratio(scaled(sum_col, 4), count_col * F.lit(10_000), 2)


# ---------------------------------------------------------------------------- E


def fm_top_products(m: SalesModel, market: str, n: int = 10) -> DataFrame:
    star = revenue_star(m, market, with_price=False)
    agg = star.groupBy("product", "category", "segment").agg(F.sum("sold_quantity").alias("quantity_sold"))
    out = agg.select(F.col("product").alias("product_name"), "category", "segment", "quantity_sold")
    return top_n(out, [F.col("quantity_sold").desc(), "product_name", "category", "segment"], n)


def fm_top_categories(m: SalesModel, market: str, n: int = 10) -> DataFrame:
    star = revenue_star(m, market, with_price=False)
    agg = star.groupBy("category", "division").agg(F.sum("sold_quantity").alias("quantity_sold"))
    return top_n(agg, [F.col("quantity_sold").desc(), "category", "division"], n)


def fm_customers_by_platform_channel(m: SalesModel, market: str) -> DataFrame:
    c = m.dim_customer.filter(F.col("market") == market)
    return c.groupBy("platform", "channel").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(
        F.col("customer_count").desc(), "platform", "channel"
    )


def fm_customers_by_subzone(m: SalesModel, market: str) -> DataFrame:
    c = m.dim_customer.filter(F.col("market") == market)
    return c.groupBy("sub_zone").agg(F.count(F.lit(1)).alias("customer_count")).orderBy(F.col("customer_count").desc(), "sub_zone")


def fm_revenue_by_subzone_customer(m: SalesModel, market: str) -> DataFrame:
    star = revenue_star(m, market)
    agg = star.groupBy("sub_zone", "customer_code", "customer").agg(_rev_total())
    return agg.select("sub_zone", "customer", F.col("_rev").cast("double").alias("total_revenue")).orderBy(
        F.col("total_revenue").desc(), "sub_zone", "customer"
    )


def fm_quantity_by_subzone(m: SalesModel, market: str) -> DataFrame:
    star = revenue_star(m, market, with_product=False, with_price=False)
    return star.groupBy("sub_zone").agg(F.sum("sold_quantity").alias("total_sales")).orderBy(F.col("total_sales").desc(), "sub_zone")


def fm_top_customers_revenue(m: SalesModel, market: str, n: int = 5) -> DataFrame:
    agg = revenue_star(m, market).groupBy("customer_code", "customer").agg(_rev_total())
    return top_n(agg, [F.col("_rev").desc(), "customer_code"], n).select(
        "customer_code", "customer", F.col("_rev").cast("double").alias("total_revenue")
    )


def fm_purchase_frequency(m: SalesModel, market: str, n: int = 15, exact_distinct: bool = True) -> DataFrame:
    star = revenue_star(m, market, with_product=False, with_price=False)
    if exact_distinct:
        agg = distinct_days("date", star, ["customer_code", "customer"], "purchase_frequency")
    else:
        agg = star.groupBy("customer_code", "customer").agg(distinct_count("date", False).alias("purchase_frequency"))
    return top_n(agg, [F.col("purchase_frequency").desc(), "customer_code"], n)


def fm_avg_order_value(m: SalesModel, market: str, n: int = 15) -> DataFrame:
    agg = revenue_star(m, market).groupBy("customer_code", "customer").agg(_rev_total(), F.count("rev").alias("_n"))
    out = agg.select("customer_code", "customer", _avg_rounded("_rev", F.col("_n")).alias("average_order_value"))
    return top_n(out, [F.col("average_order_value").desc(), "customer_code"], n)


def fm_category_frequency(m: SalesModel, market: str, n: int = 15) -> DataFrame:
    star = revenue_star(m, market, with_price=False)
    agg = star.groupBy("category").agg(F.count(F.lit(1)).alias("purchase_frequency"))
    return top_n(agg, [F.col("purchase_frequency").desc(), "category"], n)


def fm_category_sales_pct(m: SalesModel, market: str, n: int = 15) -> DataFrame:
    agg = cut_lineage(revenue_star(m, market).groupBy("category", "division").agg(_rev_total()))
    total = grand_total(agg, "_rev")
    out = agg.select(
        "category", "division",
        F.col("_rev").cast("double").alias("total_sales"),
        (F.try_divide(F.col("_rev").cast("double"), total.cast("double")) * F.lit(100)).alias("sales_percentage"),
        "_rev",
    )
    return top_n(out, [F.col("_rev").desc(), "category", "division"], n).drop("_rev")


def _performance(months: DataFrame, keys: list[str], exact_distinct: bool = True) -> DataFrame:
    agg = by_group(months, keys, keys, exact_distinct)
    return agg.select(
        *keys, "customer_count", F.col("_quantity").alias("total_quantity_sold"),
        F.col("_rev").cast("double").alias("total_revenue"),
        _avg_rounded("_rev", F.col("_n")).alias("avg_order_value"),
    )


def fm_subzone_performance(m: SalesModel, market: str, exact_distinct: bool = True) -> DataFrame:
    months = market_months(m).where(F.col("market") == market)
    return _performance(months, ["sub_zone"], exact_distinct).orderBy(F.col("total_revenue").desc(), "sub_zone")


def fm_category_by_subzone(m: SalesModel, market: str) -> DataFrame:
    agg = revenue_star(m, market).groupBy("sub_zone", "category").agg(
        F.sum("sold_quantity").alias("quantity_sold"), _rev_total()
    )
    return agg.select(
        "sub_zone", "category", "quantity_sold", F.col("_rev").cast("double").alias("total_revenue")
    ).orderBy("sub_zone", F.col("total_revenue").desc(), "category")


# ---------------------------------------------------------------------------- F


def _market_group(market: str) -> Column:
    return F.when(F.col("market") == market, F.lit(market)).otherwise(F.lit(OTHER_MARKETS)).alias("market_group")


def _per_customer(months: DataFrame, keys: list[Column | str], exact_distinct: bool = True) -> DataFrame:
    names = [k if isinstance(k, str) else "market_group" for k in keys]
    agg = by_group(months, keys, names, exact_distinct)
    return agg.select(
        *names,
        F.col("_rev").cast("double").alias("total_revenue"),
        "customer_count",
        exact_round_ratio(scaled("_rev", 4), F.col("customer_count") * F.lit(10_000), 2).alias("revenue_per_customer"),
    )


def cmp_market_vs_rest(m: SalesModel, market: str, exact_distinct: bool = True) -> DataFrame:
    return _per_customer(market_months(m), [_market_group(market)], exact_distinct).orderBy(F.col("total_revenue").desc(), "market_group")


def cmp_category_preferences(m: SalesModel, market: str) -> DataFrame:
    agg = revenue_star(m).groupBy("category", _market_group(market)).agg(
        F.sum("sold_quantity").alias("quantity_sold"), _rev_total()
    )
    return agg.select(
        "category", "market_group", "quantity_sold", F.col("_rev").cast("double").alias("total_revenue")
    ).orderBy("category", F.col("total_revenue").desc(), "market_group")


def cmp_regions(m: SalesModel, exact_distinct: bool = True) -> DataFrame:
    return _performance(market_months(m), ["region"], exact_distinct).orderBy(F.col("total_revenue").desc(), "region")


def cmp_top_markets_by_region(m: SalesModel, n: int = 3) -> DataFrame:
    agg = revenue_star(m).groupBy("region", "market").agg(_rev_total())
    ranked = top_n_per_group(agg, ["region"], [F.col("_rev").desc()], n, rank_col="market_rank", dense=False)
    return ranked.orderBy("region", "market_rank", "market").select(
        "region", "market", F.col("_rev").cast("double").alias("total_revenue")
    )


def cmp_channel_effectiveness(m: SalesModel, exact_distinct: bool = True) -> DataFrame:
    return _per_customer(market_months(m), ["market", "channel"], exact_distinct).orderBy("market", F.col("total_revenue").desc(), "channel")


def cmp_platform_effectiveness(m: SalesModel, exact_distinct: bool = True) -> DataFrame:
    return _per_customer(market_months(m), ["market", "platform"], exact_distinct).orderBy("market", F.col("total_revenue").desc(), "platform")
