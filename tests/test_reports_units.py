
from helpers import D, model

from starledger.plans import advanced, finance, headline, supply
from starledger.sources.logs import session_logs_from_rows

CUST = [
    (1, "Acme", "E-Commerce", "Retailer", "India", "India-1", "APAC"),
    (2, "Bolt", "Brick & Mortar", "Direct", "India", "India-2", "APAC"),
    (3, "Core", "Brick & Mortar", "Direct", "USA", "USA-1", "NA"),
]
PROD = [(10, "P & A", "Peripherals", "Mouse", "M1", "std"), (20, "PC", "Notebook", "Laptop", "L1", "std")]


def test_market_badge_threshold_is_strict(spark):
    sales = [(D(2021, 1, 1), 10, 1, 60), (D(2021, 2, 1), 10, 2, 40)]
    m = model(spark, CUST, PROD, sales, [(10, 2021, 1.0)])
    assert finance.market_badge(m, 2021, "India", 100).first().badge == "Silver"  # exactly 100: not > 100
    assert finance.market_badge(m, 2021, "India", 99).first().badge == "Gold"
    none = finance.market_badge(m, 2021, "USA", 0).first()  # no sales: NULL quantity -> Silver
    assert none.total_qty is None and none.badge == "Silver"


def test_value_segments_at_thresholds(spark):
    sales = [(D(2021, 1, 1), 10, 1, 100), (D(2021, 1, 1), 10, 2, 50), (D(2021, 1, 1), 10, 3, 49)]
    m = model(spark, CUST, PROD, sales, [(10, 2021, 1.0)])
    got = {r.customer: r.customer_segment for r in headline.customer_value_segments(m, high=100, medium=50).collect()}
    assert got == {"Acme": "High Value", "Bolt": "Medium Value", "Core": "Low Value"}


def test_clv_with_zero_lifetime(spark):
    sales = [(D(2021, 1, 1), 10, 1, 2), (D(2021, 1, 1), 20, 1, 1), (D(2021, 3, 1), 10, 2, 1), (D(2021, 5, 1), 10, 2, 1)]
    m = model(spark, CUST, PROD, sales, [(10, 2021, 10.0), (20, 2021, 100.0)])
    rows = {r.customer_code: r for r in advanced.adv_clv(m, "India").collect()}
    assert rows[1].customer_lifetime_days == 0 and rows[1].projected_3year_clv == 120.0 * 3
    days = (D(2021, 5, 1) - D(2021, 3, 1)).days
    assert rows[2].customer_lifetime_days == days
    assert rows[2].projected_3year_clv == 20.0 / days * 365 * 3
    assert rows[2].avg_order_value == 10.0


def test_accuracy_clamp_and_zero_forecast(spark):
    sales = [(D(2021, 1, 1), 10, 1, 10), (D(2021, 1, 1), 10, 2, 5)]
    forecasts = [(D(2021, 1, 1), 10, 1, 3), (D(2021, 1, 1), 10, 3, 10)]
    m = model(spark, CUST, PROD, sales, [(10, 2021, 1.0)], forecasts)
    act = supply.act_est(m)
    rows = {r.customer_code: r for r in supply.forecast_accuracy(act, m.dim_customer, 2021).collect()}
    assert rows[1].abs_err_pct == 7 * 100 / 3 and rows[1].forecast_accuracy == 0.0  # > 100% error -> 0
    assert rows[2].abs_err_pct is None and rows[2].forecast_accuracy is None  # no forecast -> NULL
    assert rows[3].abs_err_pct == 100.0 and rows[3].forecast_accuracy == 0.0  # exactly 100%: 100 - 100
    rounded = {r.customer_code: r for r in supply.forecast_accuracy_table(act, m.dim_customer, 2021, round_pct=True).collect()}
    assert rounded[1].abs_error_pct == 233.33 and rounded[1].net_error_pct == -233.3


def test_literal_log_rows_are_typed(spark):
    rows = [("2022-10-04 08:14:07", "898812", "523", "opened | form"), ("2022-10-22 18:10:06", "188567", "707", "closed | form")]
    logs = session_logs_from_rows(spark, rows)
    assert [f.dataType.simpleString() for f in logs.schema.fields] == ["timestamp_ntz", "bigint", "bigint", "string"]
    assert [(r.session_id, r.user_id, r.log) for r in logs.collect()] == [(898812, 523, "opened | form"), (188567, 707, "closed | form")]


def test_act_est_typed_rejects_nulls(spark):
    import pytest
    df = spark.createDataFrame([(D(2021, 1, 1), 2021, 1, 1, None, 3)], "date date, fiscal_year int, product_code long, customer_code long, sold_quantity long, forecast_quantity long")
    with pytest.raises(Exception) as err:
        supply.act_est_typed(df).collect()
    assert "sold_quantity must not be NULL" in str(err.value)


def test_market_names_may_be_compared_without_case(spark, tiny_model):
    from starledger.plans import finance, revenue
    from starledger.plans.catalog import P

    upper, lower = P.market.upper(), P.market.lower()
    badge = lambda name, **kw: finance.market_badge(tiny_model, P.fiscal_year, name, **kw).first().total_qty
    assert badge(lower) is None and badge(lower, ignore_case=True) == badge(upper) == badge(P.market)
    top = lambda name, **kw: revenue.top_n_customers_net_sales(tiny_model, name, P.fiscal_year, 5, **kw).collect()
    assert top(lower) == [] and top(lower, ignore_case=True) == top(P.market)
