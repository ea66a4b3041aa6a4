"""SQL users: the registered views and get_fiscal_year give the same answers as the API."""

from starledger.plans import finance, revenue, supply
from starledger.plans.catalog import P
from starledger.plans.sql_surface import register_sql


def test_sql_surface_matches_api(spark, tiny_model):
    names = register_sql(spark, tiny_model)
    assert {"net_sales", "gross_sales", "fact_act_est", "dim_customer"} <= set(names)
    plan = spark.sql("SELECT get_fiscal_year(DATE'2020-09-01') AS fy")
    assert plan.first().fy == 2021
    assert "PythonUDF" not in plan._jdf.queryExecution().executedPlan().toString()

    yearly = spark.sql(
        f"""SELECT fiscal_year, CAST(SUM(gross_price_total) AS DOUBLE) AS total
            FROM gross_sales WHERE customer_code = {P.customer_code} GROUP BY fiscal_year"""
    )
    api = finance.yearly_gross_sales_customer(tiny_model, P.customer_code)
    assert sorted(map(tuple, yearly.collect())) == sorted(map(tuple, api.collect()))

    markets = spark.sql(
        f"""SELECT market, CAST(ROUND(SUM(net_sales), -4) / 10000 AS BIGINT) AS u
            FROM net_sales WHERE fiscal_year = {P.fiscal_year} GROUP BY market ORDER BY u DESC, market LIMIT 5"""
    )
    api = revenue.top_n_markets_net_sales(tiny_model, P.fiscal_year, 5)
    assert [(r.market, r.u / 100) for r in markets.collect()] == [(r.market, r.net_sales_mln) for r in api.collect()]

    acc = spark.sql(
        f"""SELECT customer_code, SUM(ABS(forecast_quantity - sold_quantity)) AS abs_err
            FROM fact_act_est WHERE fiscal_year = {P.fiscal_year} GROUP BY customer_code"""
    )
    api = supply.forecast_accuracy(supply.act_est(tiny_model, [P.fiscal_year]), tiny_model.dim_customer, P.fiscal_year)
    assert sorted(map(tuple, acc.collect())) == sorted((r.customer_code, r.abs_err) for r in api.collect())


def test_procedures_are_sql_table_functions(spark, tiny_model):
    """SELECT * FROM procedure(...) gives the report's rows, without Python in the plan."""
    register_sql(spark, tiny_model)
    m, fy, prev = tiny_model, P.fiscal_year, P.prev_fiscal_year
    calls = {
        "get_monthly_gross_sales_for_customer('5, 17,42')": finance.monthly_gross_sales_customers(m, [5, 17, 42]),
        f"get_market_badge('{P.market}', {fy}, {P.badge_threshold})": finance.market_badge(m, fy, P.market, P.badge_threshold),
        f"get_market_badge('', {fy})": finance.market_badge(m, fy),
        f"get_top_n_markets_by_net_sales({prev}, 3)": revenue.top_n_markets_net_sales(m, prev, 3),
        f"get_top_n_customers_by_net_sales('{P.market}', {fy}, 5)": revenue.top_n_customers_net_sales(m, P.market, fy, 5),
        f"get_top_n_products_by_net_sales({fy}, 5)": revenue.top_n_products_net_sales(m, fy, 5),
        f"get_top_n_products_per_division_by_qty_sold({prev}, 2)": revenue.top_n_products_per_division(m, prev, 2),
        f"get_forecast_accuracy({prev})": supply.forecast_accuracy(supply.act_est(m, [prev]), m.dim_customer, prev),
    }
    for call, api in calls.items():
        got = spark.sql(f"SELECT * FROM {call}")
        assert got.columns == api.columns, call
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, api.collect()), key=str), call
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    joined = spark.sql(f"SELECT t.market, b.badge FROM get_top_n_markets_by_net_sales({fy}, 2) t JOIN get_market_badge('{P.market}', {fy}, 0) b ON true")
    assert joined.count() == 2
