"""The report catalogue: one key per report, bound to its parameters.

Each entry maps a key to ``fn(spark, tables_dir, model) -> DataFrame`` where
``model`` is the star for ``tables_dir``. ``Params`` holds the parameter values
used by the registry (the stand-ins for the reference's hard-coded constants).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from starledger.plans import advanced, finance, headline, market, quality, revenue, supply
from starledger.sources.act_est import integrate_act_est
from starledger.sources.dirty import dirty_dim_customer, dirty_dim_product, dirty_fact_sales, inconsistent_star, star_with_gaps
from starledger.sources.logs import read_events
from starledger.sources.star import SalesModel


@dataclass(frozen=True)
class Params:
    market: str = "NATION_2"
    fiscal_year: int = 1998
    prev_fiscal_year: int = 1997
    customer_code: int = 5
    customer_codes: tuple[int, ...] = (5, 17, 42)
    badge_threshold: int = 9_500
    high_value: int = 1_300_000
    medium_value: int = 1_000_000
    as_of: _dt.date = _dt.date(2001, 8, 1)
    log_as_of: _dt.date = _dt.date(2024, 1, 30)
    log_days: int = 5


P = Params()

Report = Callable[[SparkSession, str, SalesModel], DataFrame]


def _orders(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/orders.parquet").select("o_orderkey", "o_orderdate")


def _act(m: SalesModel, *years: int) -> DataFrame:
    return supply.act_est(m, years or None)


REPORTS: dict[str, Report] = {
    # A. data quality (dirty variants of the star tables)
    "dq_null_customers": lambda s, b, m: quality.dq_null_customers(dirty_dim_customer(m.dim_customer)),
    "dq_fill_customers": lambda s, b, m: quality.dq_fill_customers(dirty_dim_customer(m.dim_customer)),
    "dq_dup_customers": lambda s, b, m: quality.dq_dup_customers(dirty_dim_customer(m.dim_customer)),
    "dq_null_products": lambda s, b, m: quality.dq_null_products(dirty_dim_product(m.dim_product)),
    "dq_fill_products": lambda s, b, m: quality.dq_fill_products(dirty_dim_product(m.dim_product)),
    "dq_dup_products": lambda s, b, m: quality.dq_dup_products(dirty_dim_product(m.dim_product)),
    "dq_null_sales": lambda s, b, m: quality.dq_null_sales(dirty_fact_sales(m.fact_sales_monthly)),
    "dq_dup_sales": lambda s, b, m: quality.dq_dup_sales(dirty_fact_sales(m.fact_sales_monthly)),
    "dq_dependencies": lambda s, b, m: quality.dq_dependencies(inconsistent_star(m)),
    "dq_orphans": lambda s, b, m: quality.dq_orphans(star_with_gaps(m)),
    # B. financial
    "fiscal_year_of_date": lambda s, b, m: finance.fiscal_year_of_date(_orders(s, b)),
    "customer_fy_transactions": lambda s, b, m: finance.customer_fy_transactions(m, P.customer_code, P.fiscal_year),
    "customer_fy_with_product": lambda s, b, m: finance.customer_fy_with_product(m, P.customer_code, P.fiscal_year),
    "customer_fy_with_gross_price": lambda s, b, m: finance.customer_fy_with_gross_price(m, P.customer_code, P.fiscal_year),
    "monthly_gross_sales_customer": lambda s, b, m: finance.monthly_gross_sales_customer(m, P.customer_code),
    "monthly_gross_sales_customers": lambda s, b, m: finance.monthly_gross_sales_customers(m, P.customer_codes),
    "market_badge": lambda s, b, m: finance.market_badge(m, P.fiscal_year, P.market, P.badge_threshold),
    "market_badges": lambda s, b, m: finance.market_badges(m, P.fiscal_year, P.badge_threshold),
    "yearly_gross_sales_customer": lambda s, b, m: finance.yearly_gross_sales_customer(m, P.customer_code),
    # C. revenue waterfall, customer & product
    "preinv_detail_customer": lambda s, b, m: revenue.preinv_detail_customer(m, P.customer_code, P.fiscal_year),
    "preinv_detail_all": lambda s, b, m: revenue.preinv_detail_all(m, P.fiscal_year),
    "preinv_detail_dim_date": lambda s, b, m: revenue.preinv_detail_dim_date(m, P.fiscal_year),
    "preinv_detail_fy_column": lambda s, b, m: revenue.preinv_detail_fy_column(m, P.fiscal_year),
    "net_invoice_sales": lambda s, b, m: revenue.net_invoice_sales(m, P.fiscal_year),
    "view_sales_preinv_discount": lambda s, b, m: revenue.view_sales_preinv_discount(m),
    "net_invoice_sales_from_view": lambda s, b, m: revenue.net_invoice_sales_from_view(m),
    "view_sales_postinv_discount": lambda s, b, m: revenue.view_sales_postinv_discount(m),
    "net_sales_report": lambda s, b, m: revenue.net_sales_report(m),
    "view_net_sales": lambda s, b, m: revenue.view_net_sales(m),
    "top5_markets_net_sales": lambda s, b, m: revenue.top_n_markets_net_sales(m, P.fiscal_year, 5),
    "top_n_markets_net_sales": lambda s, b, m: revenue.top_n_markets_net_sales(m, P.prev_fiscal_year, 3),
    "top_n_customers_net_sales": lambda s, b, m: revenue.top_n_customers_net_sales(m, P.market, P.fiscal_year, 5),
    "customer_pct_net_sales": lambda s, b, m: revenue.customer_pct_net_sales(m, P.fiscal_year),
    "customer_pct_by_region": lambda s, b, m: revenue.customer_pct_by_region(m, P.fiscal_year),
    "top3_products_per_division": lambda s, b, m: revenue.top_n_products_per_division(m, P.fiscal_year, 3),
    "top_n_products_per_division": lambda s, b, m: revenue.top_n_products_per_division(m, P.prev_fiscal_year, 2),
    "view_gross_sales": lambda s, b, m: revenue.view_gross_sales(m),
    "top_n_products_net_sales": lambda s, b, m: revenue.top_n_products_net_sales(m, P.fiscal_year, 5),
    "region_net_sales_breakdown": lambda s, b, m: revenue.region_net_sales_breakdown(m, P.fiscal_year),
    "top2_markets_per_region_gross": lambda s, b, m: revenue.top_n_markets_per_region_gross(m, P.fiscal_year, 2),
    # D. supply chain
    "act_est_build": lambda s, b, m: integrate_act_est(m.fact_sales_monthly, m.fact_forecast_monthly),
    "session_log_ingest": lambda s, b, m: supply.session_log_ingest(read_events(s, b)),
    "session_log_purge": lambda s, b, m: supply.session_log_purge(read_events(s, b), P.log_as_of, P.log_days),
    "forecast_accuracy": lambda s, b, m: supply.forecast_accuracy(_act(m, P.fiscal_year), m.dim_customer, P.fiscal_year),
    "forecast_accuracy_proc": lambda s, b, m: supply.forecast_accuracy(_act(m, P.prev_fiscal_year), m.dim_customer, P.prev_fiscal_year),
    "act_est_typed": lambda s, b, m: supply.act_est_typed(_act(m)),
    "forecast_accuracy_temp": lambda s, b, m: supply.forecast_accuracy_table(_act(m, P.fiscal_year), m.dim_customer, P.fiscal_year),
    "forecast_accuracy_rounded": lambda s, b, m: supply.forecast_accuracy_table(_act(m, P.fiscal_year), m.dim_customer, P.fiscal_year, round_pct=True),
    "forecast_accuracy_rounded_prev": lambda s, b, m: supply.forecast_accuracy_table(_act(m, P.prev_fiscal_year), m.dim_customer, P.prev_fiscal_year, round_pct=True),
    "forecast_accuracy_drop": lambda s, b, m: supply.forecast_accuracy_drop(_act(m, P.prev_fiscal_year, P.fiscal_year), m.dim_customer, P.prev_fiscal_year, P.fiscal_year),
    # E. focus market
    "fm_top_products": lambda s, b, m: market.fm_top_products(m, P.market, 10),
    "fm_top_categories": lambda s, b, m: market.fm_top_categories(m, P.market, 10),
    "fm_customers_by_platform_channel": lambda s, b, m: market.fm_customers_by_platform_channel(m, P.market),
    "fm_customers_by_subzone": lambda s, b, m: market.fm_customers_by_subzone(m, P.market),
    "fm_revenue_by_subzone_customer": lambda s, b, m: market.fm_revenue_by_subzone_customer(m, P.market),
    "fm_quantity_by_subzone": lambda s, b, m: market.fm_quantity_by_subzone(m, P.market),
    "fm_top_customers_revenue": lambda s, b, m: market.fm_top_customers_revenue(m, P.market, 5),
    "fm_purchase_frequency": lambda s, b, m: market.fm_purchase_frequency(m, P.market, 15),
    "fm_avg_order_value": lambda s, b, m: market.fm_avg_order_value(m, P.market, 15),
    "fm_category_frequency": lambda s, b, m: market.fm_category_frequency(m, P.market, 15),
    "fm_category_sales_pct": lambda s, b, m: market.fm_category_sales_pct(m, P.market, 15),
    "fm_subzone_performance": lambda s, b, m: market.fm_subzone_performance(m, P.market),
    "fm_category_by_subzone": lambda s, b, m: market.fm_category_by_subzone(m, P.market),
    # F. comparative
    "cmp_market_vs_rest": lambda s, b, m: market.cmp_market_vs_rest(m, P.market),
    "cmp_category_preferences": lambda s, b, m: market.cmp_category_preferences(m, P.market),
    "cmp_regions": lambda s, b, m: market.cmp_regions(m),
    "cmp_top_markets_by_region": lambda s, b, m: market.cmp_top_markets_by_region(m, 3),
    "cmp_channel_effectiveness": lambda s, b, m: market.cmp_channel_effectiveness(m),
    "cmp_platform_effectiveness": lambda s, b, m: market.cmp_platform_effectiveness(m),
    # G. advanced
    "adv_clv": lambda s, b, m: advanced.adv_clv(m, P.market, 20),
    "adv_churn_rate": lambda s, b, m: advanced.adv_churn_rate(m, P.market),
    "adv_at_risk_customers": lambda s, b, m: advanced.adv_at_risk_customers(m, P.market, P.as_of, 20),
    "adv_category_pairs": lambda s, b, m: advanced.adv_category_pairs(m, P.market, 15),
    "adv_division_pairs": lambda s, b, m: advanced.adv_division_pairs(m, P.market, 15),
    "adv_customer_segments": lambda s, b, m: advanced.adv_customer_segments(m, P.market),
    # H. headline
    "gross_revenue_top_markets": lambda s, b, m: headline.gross_revenue_top_markets(m, 10),
    "customer_value_segments": lambda s, b, m: headline.customer_value_segments(m, P.high_value, P.medium_value),
    "top_products_quantity": lambda s, b, m: headline.top_products_quantity(m, 10),
    "fm_top_customers_platform": lambda s, b, m: headline.fm_top_customers_platform(m, P.market, 10),
    "forecast_to_sales_ratio": lambda s, b, m: headline.forecast_to_sales_ratio(m, 10),
    "forecast_to_sales_ratio_keyed": lambda s, b, m: headline.forecast_to_sales_ratio(
        m, 10, keys=("product_code", "fiscal_year", "date", "customer_code")
    ),
    "revenue_trend_market_vs_rest": lambda s, b, m: headline.revenue_trend_market_vs_rest(m, P.market),
}
