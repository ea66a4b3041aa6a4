"""Reports that sort return their rows in that order, with a total order on ties."""

import datetime as dt

import pytest

import __spark_entry__
from starledger.plans.catalog import REPORTS
from conftest import SF_TINY

#: key -> (sort columns, descending or not); ties are broken by the columns that follow.
ORDERED = {
    "forecast_accuracy": (("forecast_accuracy", True), ("customer_code", False)),
    "forecast_accuracy_temp": (("forecast_accuracy", True), ("customer_code", False)),
    "forecast_accuracy_drop": (("forecast_acc_prev", True), ("customer_code", False)),
    "customer_pct_net_sales": (("net_sales_mln", True), ("customer", False)),
    "customer_pct_by_region": (("region", False), ("pct_share_region", True), ("customer", False)),
    "region_net_sales_breakdown": (("region", False), ("net_sales_mln", True), ("customer", False)),
    "monthly_gross_sales_customers": (("date", True),),
    "top_n_markets_net_sales": (("net_sales_mln", True), ("market", False)),
    "top_n_customers_net_sales": (("net_sales_mln", True), ("customer", False)),
    "top_n_products_net_sales": (("net_sales_mln", True), ("product", False)),
    "fm_customers_by_platform_channel": (("customer_count", True), ("platform", False), ("channel", False)),
    "fm_customers_by_subzone": (("customer_count", True), ("sub_zone", False)),
    "fm_quantity_by_subzone": (("total_sales", True), ("sub_zone", False)),
    "fm_top_categories": (("quantity_sold", True), ("category", False)),
    "fm_category_by_subzone": (("sub_zone", False), ("total_revenue", True), ("category", False)),
    "cmp_market_vs_rest": (("total_revenue", True), ("market_group", False)),
    "cmp_category_preferences": (("category", False), ("total_revenue", True), ("market_group", False)),
    "cmp_regions": (("total_revenue", True), ("region", False)),
    "cmp_channel_effectiveness": (("market", False), ("total_revenue", True), ("channel", False)),
    "cmp_platform_effectiveness": (("market", False), ("total_revenue", True), ("platform", False)),
    "adv_category_pairs": (("frequency", True), ("category1", False), ("category2", False)),
    "adv_at_risk_customers": (("last_purchase_date", True), ("customer_code", False)),
    "gross_revenue_top_markets": (("gross_revenue_mln", True), ("market", False)),
    "top_products_quantity": (("qty_sold_mln", True), ("product", False)),
    "revenue_trend_market_vs_rest": (("fiscal_year", False),),
}


class Reversed:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return other.value == self.value


def sort_key(row, columns):
    """Descending columns have nulls last."""
    out = []
    for name, descending in columns:
        value = row[name]
        low = dt.date.min if isinstance(value, dt.date) or name.endswith("date") else float("-inf")
        out.append(Reversed(low if value is None else value) if descending else value)
    return out


@pytest.mark.parametrize("key", sorted(ORDERED))
def test_rows_come_in_order(spark, key):
    assert key in REPORTS
    rows = __spark_entry__.queries()[key](spark, SF_TINY).collect()
    keys = [sort_key(r, ORDERED[key]) for r in rows]
    assert rows and keys == sorted(keys)
