"""The model as a SQL surface: tables, the four waterfall views and the fiscal-year
function, so SQL users can keep writing their reports as SQL statements.

``get_fiscal_year`` is a SQL function (``RETURN year(add_months(d, 4))``): Spark
inlines it as a native expression — no Python runs per row. The reference's stored
procedures are SQL table functions: ``SELECT * FROM get_forecast_accuracy(2021)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from starledger.constants import BADGE_GOLD, BADGE_SILVER, DEFAULT_BADGE_THRESHOLD, DEFAULT_MARKET, FULL_ACCURACY_PCT
from starledger.functions.dates import FISCAL_SHIFT_MONTHS
from starledger.plans import views
from starledger.plans.supply import act_est
from starledger.sources.star import SalesModel

FISCAL_YEAR_FUNCTION = (
    "CREATE OR REPLACE TEMPORARY FUNCTION get_fiscal_year(calendar_date DATE) RETURNS INT "
    f"RETURN CAST(year(add_months(calendar_date, {FISCAL_SHIFT_MONTHS})) AS INT)"
)


_PCT = "TRY_DIVIDE(CAST({0} * 100 AS DOUBLE), CAST({1} AS DOUBLE))"


def _top(select: str, keys: list[str], units: str, source: str, carried: str = "") -> str:
    """The first ``in_top_n`` rows by ``u``, then name. A parameter can't be a LIMIT; ranks within parts come
    first, so that the last ranking sees a few rows of each part, not all names."""
    names = ", ".join(keys)
    order = f"u DESC, {keys[0]}"
    return (
        f"SELECT {select} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY part ORDER BY {order}) AS place_in_part "
        f"FROM (SELECT {names}, {units} AS u, PMOD(XXHASH64({names}), 64) AS part {source} GROUP BY {names})) WHERE place_in_part <= in_top_n) WHERE place <= in_top_n"
    )


_MLN = "CAST(ROUND(SUM(net_sales), -4) / 10000 AS DECIMAL(38,0))"
_MARKET = f"COALESCE(NULLIF(in_market, ''), '{DEFAULT_MARKET}')"
#: The reference's procedures: parameters, result columns, body over the registered views.
TABLE_FUNCTIONS = {
    "get_monthly_gross_sales_for_customer": (
        "in_customer_codes STRING", "date DATE, gross_price_total DOUBLE",
        "SELECT s.date, CAST(SUM(CAST(ROUND(s.sold_quantity * g.gross_price, 2) AS DECIMAL(16,2))) AS DOUBLE) FROM fact_sales_monthly s "
        "JOIN fact_gross_price g ON g.product_code = s.product_code AND g.fiscal_year = s.fiscal_year "
        "WHERE FIND_IN_SET(CAST(s.customer_code AS STRING), REPLACE(in_customer_codes, ' ', '')) > 0 GROUP BY s.date",
    ),
    "get_market_badge": (
        f"in_market STRING, in_fiscal_year INT, in_threshold BIGINT DEFAULT {DEFAULT_BADGE_THRESHOLD}",
        "market STRING, fiscal_year INT, total_qty BIGINT, badge STRING",
        f"SELECT {_MARKET}, in_fiscal_year, q, IF(q > in_threshold, '{BADGE_GOLD}', '{BADGE_SILVER}') FROM (SELECT SUM(s.sold_quantity) AS q FROM fact_sales_monthly s "
        f"JOIN dim_customer c ON c.customer_code = s.customer_code WHERE s.fiscal_year = in_fiscal_year AND c.market = {_MARKET})",
    ),
    "get_top_n_markets_by_net_sales": (
        "in_fiscal_year INT, in_top_n INT", "market STRING, net_sales_mln DOUBLE",
        _top("market, CAST(u AS DOUBLE) / 100", ["market"], _MLN, "FROM net_sales WHERE fiscal_year = in_fiscal_year"),
    ),
    "get_top_n_customers_by_net_sales": (
        "in_market STRING, in_fiscal_year INT, in_top_n INT", "customer STRING, net_sales_mln DOUBLE",
        _top("customer, CAST(u AS DOUBLE) / 100", ["customer"], _MLN, "FROM (SELECT c.customer, n.net_sales FROM net_sales n JOIN dim_customer c ON c.customer_code = n.customer_code WHERE n.fiscal_year = in_fiscal_year AND n.market = in_market)"),
    ),
    "get_top_n_products_by_net_sales": (
        "in_fiscal_year INT, in_top_n INT", "product STRING, net_sales_mln DOUBLE",
        _top("product, CAST(u AS DOUBLE) / 100", ["product"], _MLN, "FROM net_sales WHERE fiscal_year = in_fiscal_year"),
    ),
    "get_top_n_products_per_division_by_qty_sold": (
        "in_fiscal_year INT, in_top_n INT", "division STRING, product STRING, total_qty BIGINT, drnk INT",
        "SELECT division, product, total_qty, drnk FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY division ORDER BY total_qty DESC) AS drnk FROM (SELECT p.division, p.product, SUM(s.sold_quantity) AS total_qty "
        "FROM fact_sales_monthly s JOIN dim_product p ON p.product_code = s.product_code WHERE s.fiscal_year = in_fiscal_year GROUP BY p.division, p.product)) WHERE drnk <= in_top_n",
    ),
    "get_forecast_accuracy": (
        "in_fiscal_year INT",
        "customer_code BIGINT, total_sold_qty BIGINT, total_forecast_qty BIGINT, net_err BIGINT, net_err_pct DOUBLE, abs_err BIGINT, abs_err_pct DOUBLE, customer_name STRING, market STRING, forecast_accuracy DOUBLE",
        f"SELECT customer_code, sold, planned, net, {_PCT.format('net', 'planned')}, err, pct, customer, market, IF(pct > {FULL_ACCURACY_PCT}, 0D, {float(FULL_ACCURACY_PCT)}D - pct) FROM "
        f"(SELECT e.*, c.customer, c.market, {_PCT.format('err', 'planned')} AS pct FROM (SELECT customer_code, SUM(sold_quantity) AS sold, SUM(forecast_quantity) AS planned, "
        "SUM(forecast_quantity - sold_quantity) AS net, SUM(ABS(forecast_quantity - sold_quantity)) AS err FROM fact_act_est WHERE fiscal_year = in_fiscal_year GROUP BY customer_code) e "
        "JOIN dim_customer c ON c.customer_code = e.customer_code)",
    ),
}


def register_procedures(spark: SparkSession) -> list[str]:
    """The procedures as temporary SQL table functions over the registered views; their names."""
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(TABLE_FUNCTIONS)


def register_sql(spark: SparkSession, m: SalesModel) -> list[str]:
    """Register tables, views, ``get_fiscal_year`` and the procedures; return the registered view names."""
    m.register_views()
    extra = {
        "fact_act_est": act_est(m),
        "gross_sales": views.gross_sales(m),
        "sales_preinv_discount": views.sales_preinv_discount(m),
        "sales_postinv_discount": views.sales_postinv_discount(m),
        "net_sales": views.net_sales(m),
    }
    for name, df in extra.items():
        df.createOrReplaceTempView(name)
    spark.sql(FISCAL_YEAR_FUNCTION)
    register_procedures(spark)
    return list(m.tables()) + list(extra)
