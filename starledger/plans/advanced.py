"""G. Advanced customer analytics: lifetime value, churn, at-risk, baskets, segments."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.constants import (
    AT_RISK_MONTHS,
    CHURN_LOOKBACK_MONTHS,
    CLV_YEARS,
    DAYS_PER_YEAR,
    SEGMENT_HIGH,
    SEGMENT_LOW,
    SEGMENT_MEDIUM,
    SEGMENT_PERCENTILES,
)

from starledger.functions.money import exact_round_ratio, scaled
from starledger.operators.pairs import ordered_pair_counts
from starledger.operators.percentiles import cume_dist_cutoffs_many
from starledger.operators.ranking import top_n
from starledger.operators.shares import grand_total
from starledger.plans.views import revenue_star
from starledger.session import cut_lineage
from starledger.sources.star import SalesModel


def customer_stats(m: SalesModel, market: str) -> DataFrame:
    """Per customer of the market: first/last month, months with purchases, spend."""
    star = revenue_star(m, market)
    return star.groupBy("customer_code", "customer").agg(
        F.min("date").alias("first_purchase_date"),
        F.max("date").alias("last_purchase_date"),
        F.count_distinct("date").alias("purchase_frequency"),
        F.sum("rev").alias("total_spent"),
        F.count("rev").alias("_n"),
    )


def adv_clv(m: SalesModel, market: str, n: int = 20) -> DataFrame:
    st = customer_stats(m, market)
    days = F.datediff("last_purchase_date", "first_purchase_date")
    spent = F.col("total_spent").cast("double")
    out = st.select(
        "customer_code", "customer", "first_purchase_date", "last_purchase_date",
        days.alias("customer_lifetime_days"),
        "purchase_frequency",
        spent.alias("total_spent"),
        (spent / F.col("_n")).alias("avg_order_value"),
        F.when(days > 0, spent / days * DAYS_PER_YEAR * CLV_YEARS).otherwise(spent * CLV_YEARS).alias("projected_3year_clv"),
        F.col("total_spent").alias("_exact"),
    )
    return top_n(out, [F.col("_exact").desc(), "customer_code"], n).drop("_exact")


def _last_months(m: SalesModel, market: str) -> DataFrame:
    """Customers of the market with their latest sales month (null without sales).

    Sales are reduced to a row per customer on the map side before they are joined, so a customer
    with many sales is no burden and the join is between two customer-sized tables.
    """
    last = m.fact_sales_monthly.groupBy("customer_code").agg(F.max("date").alias("last_purchase_date"))
    customers = m.dim_customer.filter(F.col("market") == market).select("customer_code", "customer")
    return customers.join(last, "customer_code", "left")


def adv_churn_rate(m: SalesModel, market: str) -> DataFrame:
    """% of the market's customers with no purchase, or none in the year before the
    latest purchase month of the whole sales table."""
    cutoff = m.fact_sales_monthly.agg(F.add_months(F.max("date"), -CHURN_LOOKBACK_MONTHS)).scalar()
    last = F.col("last_purchase_date")
    counts = _last_months(m, market).agg(F.count_if(last.isNull() | (last < cutoff)).alias("churned"), F.count(F.lit(1)).alias("all"))
    return counts.select((F.try_divide(F.col("churned").cast("double"), F.col("all").cast("double")) * F.lit(100)).alias("churn_rate"))


def adv_at_risk_customers(m: SalesModel, market: str, as_of: _dt.date, n: int = 20, months: int = AT_RISK_MONTHS) -> DataFrame:
    last = F.col("last_purchase_date")
    quiet = _last_months(m, market).filter(last.isNull() | (last < F.add_months(F.lit(as_of), -months)))
    return top_n(quiet, [last.desc_nulls_last(), "customer_code"], n)


def _basket_pairs(m: SalesModel, market: str, attr: str, first: str, second: str, n: int) -> DataFrame:
    rows = revenue_star(m, market, with_price=False).select("customer_code", "date", "product_code", attr)
    bounds = m.dim_product.agg(F.min("product_code"), F.max("product_code")).first()  # the dimension, not the fact
    pairs = ordered_pair_counts(rows, ["customer_code", "date"], "product_code", attr, first, second, keys=tuple(bounds))
    return top_n(pairs, [F.col("frequency").desc(), first, second], n)


def adv_category_pairs(m: SalesModel, market: str, n: int = 15) -> DataFrame:
    return _basket_pairs(m, market, "category", "category1", "category2", n)


def adv_division_pairs(m: SalesModel, market: str, n: int = 15) -> DataFrame:
    return _basket_pairs(m, market, "division", "division1", "division2", n)


def adv_customer_segments(m: SalesModel, market: str) -> DataFrame:
    """High / Medium / Low by the 80th and 50th CUME_DIST cut-offs of spend and frequency."""
    # The per-customer stats feed five scalar subqueries and the final aggregate:
    # checkpoint them once (small: one row per customer) instead of recomputing.
    st = cut_lineage(customer_stats(m, market).select("customer_code", "customer", "purchase_frequency", "total_spent"))
    cut = cume_dist_cutoffs_many(st, {"total_spent": SEGMENT_PERCENTILES, "purchase_frequency": SEGMENT_PERCENTILES})
    spent_80, spent_50 = cut["total_spent"]
    freq_80, freq_50 = cut["purchase_frequency"]
    total = grand_total(st, "total_spent")
    segment = (
        F.when((F.col("total_spent") >= spent_80) & (F.col("purchase_frequency") >= freq_80), F.lit(SEGMENT_HIGH))
        .when((F.col("total_spent") >= spent_50) & (F.col("purchase_frequency") >= freq_50), F.lit(SEGMENT_MEDIUM))
        .otherwise(F.lit(SEGMENT_LOW))
    )
    agg = st.groupBy(segment.alias("customer_segment")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("purchase_frequency").alias("_freq"),
        F.sum("total_spent").alias("_spent"),
    )
    out = agg.select(
        "customer_segment", "customer_count",
        exact_round_ratio("_freq", "customer_count", 2).alias("avg_purchase_frequency"),
        exact_round_ratio(scaled("_spent", 4), F.col("customer_count") * F.lit(10_000), 2).alias("avg_total_spent"),
        exact_round_ratio(scaled("_spent", 4) * F.lit(100), scaled(total, 4), 2).alias("revenue_percentage"),
    )
    return out.orderBy(F.col("avg_total_spent").desc(), "customer_segment")
