"""The procedure-named entry points return the same result sets as the report functions."""

from starledger import procedures as proc
from starledger.plans import finance, revenue, supply
from starledger.plans.catalog import P


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_procedures_match_reports(spark, tiny_model):
    m = tiny_model
    assert _rows(proc.get_top_n_markets_by_net_sales(m, P.fiscal_year, 3)) == _rows(revenue.top_n_markets_net_sales(m, P.fiscal_year, 3))
    assert _rows(proc.get_top_n_customers_by_net_sales(m, P.market, P.fiscal_year, 3)) == _rows(
        revenue.top_n_customers_net_sales(m, P.market, P.fiscal_year, 3)
    )
    assert _rows(proc.get_top_n_products_per_division_by_qty_sold(m, P.fiscal_year, 2)) == _rows(
        revenue.top_n_products_per_division(m, P.fiscal_year, 2)
    )
    assert _rows(proc.get_top_n_products_by_net_sales(m, P.fiscal_year, 4)) == _rows(revenue.top_n_products_net_sales(m, P.fiscal_year, 4))
    assert _rows(proc.get_monthly_gross_sales_for_customer(m, "5,17,42")) == _rows(finance.monthly_gross_sales_customers(m, [5, 17, 42]))
    badge = proc.get_market_badge(m, "", P.fiscal_year).first()  # empty market: the default market
    assert badge.market == "India" and badge.badge == "Silver" and badge.total_qty is None
    assert proc.get_market_badge(m, P.market, P.fiscal_year, threshold=0).first().badge == "Gold"
    acc = proc.get_forecast_accuracy(m, P.prev_fiscal_year)
    assert _rows(acc) == _rows(supply.forecast_accuracy(supply.act_est(m), m.dim_customer, P.prev_fiscal_year))
    fy = m.fact_sales_monthly.select(proc.get_fiscal_year("date").alias("a"), "fiscal_year").filter("a <> fiscal_year")
    assert fy.count() == 0
