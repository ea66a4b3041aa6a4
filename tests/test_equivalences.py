"""Equivalences between alternative formulations (tiny driver tables)."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from starledger.plans import headline, revenue, supply
from starledger.plans.catalog import P


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dim_date_route_equals_fiscal_year_column(tiny_model):
    a = revenue.preinv_detail_dim_date(tiny_model, P.fiscal_year)
    b = revenue.preinv_detail_fy_column(tiny_model, P.fiscal_year)
    assert _rows(a) == _rows(b.select(*a.columns))


def test_net_invoice_formulas_agree(tiny_model):
    v = revenue.net_invoice_sales_from_view(tiny_model).filter(F.col("fiscal_year") == P.fiscal_year)
    c5 = revenue.net_invoice_sales(tiny_model, P.fiscal_year)
    keys = ["date", "customer_code", "product_code", "net_invoice_sales"]
    assert _rows(v.select(*keys)) == _rows(c5.select(*keys))


def test_fan_out_ratio_equals_naive_join(tiny_model):
    m = tiny_model
    s = m.fact_sales_monthly.alias("s")
    f = m.fact_forecast_monthly.alias("f")
    naive = (
        s.join(f, ["product_code", "fiscal_year", "date"])
        .join(m.dim_customer, F.col("s.customer_code") == m.dim_customer.customer_code)
        .groupBy("customer")
        .agg(F.sum("f.forecast_quantity").alias("sf"), F.sum("s.sold_quantity").alias("ss"))
    )
    linear = headline.forecast_to_sales_ratio(m, n=10_000)
    # exact half-up rounding of 100 * sf / ss to 2 decimals
    expect = {r.customer: math.floor(Fraction(r.sf * 100, r.ss) * 100 + Fraction(1, 2)) / 100 for r in naive.collect()}
    got = {r.customer: r.forecast_accuracy_pct for r in linear.collect()}
    assert got == expect


def test_year_filtered_act_est_equals_full(tiny_model):
    full = supply.act_est(tiny_model).filter(F.col("fiscal_year") == P.fiscal_year)
    pushed = supply.act_est(tiny_model, [P.fiscal_year])
    assert _rows(full) == _rows(pushed)
    keys = supply.act_est(tiny_model).groupBy("date", "product_code", "customer_code").count().filter("count > 1")
    assert keys.count() == 0


def test_shares_sum_to_100(tiny_model):
    pct = revenue.customer_pct_net_sales(tiny_model, P.fiscal_year).agg(F.sum("pct_net_sales")).first()[0]
    assert abs(pct - 100.0) < 1e-9
    by_region = revenue.customer_pct_by_region(tiny_model, P.fiscal_year).groupBy("region").agg(F.sum("pct_share_region").alias("t"))
    assert all(abs(r.t - 100.0) < 1e-9 for r in by_region.collect())


def test_accuracy_cte_equals_temp_table(tiny_model):
    act = supply.act_est(tiny_model, [P.fiscal_year])
    a = supply.forecast_accuracy(act, tiny_model.dim_customer, P.fiscal_year).select(
        "customer_code", "total_sold_qty", "total_forecast_qty", "net_err", "net_err_pct", "abs_err", "abs_err_pct", "forecast_accuracy"
    )
    b = supply.forecast_accuracy_table(act, tiny_model.dim_customer, P.fiscal_year).select(
        "customer_code", "total_sold_qty", "total_forecast_qty", "net_error", "net_error_pct", "abs_error", "abs_error_pct", "forecast_accuracy"
    )
    assert _rows(a) == _rows(b)


def test_segments_partition_customers(tiny_model):
    from starledger.plans import advanced

    seg = advanced.adv_customer_segments(tiny_model, P.market).collect()
    customers = advanced.customer_stats(tiny_model, P.market).count()
    assert sum(r.customer_count for r in seg) == customers
    assert abs(sum(r.revenue_percentage for r in seg) - 100.0) <= 0.01 * len(seg)
    assert {r.customer_segment for r in seg} <= {"High Value", "Medium Value", "Low Value"}
