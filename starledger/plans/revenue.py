"""C. Revenue waterfall, customer and product reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.functions.money import double_ratio, gross_line_total, mln_units
from starledger.functions.text import same_text
from starledger.operators.ranking import top_n, top_n_per_group
from starledger.operators.shares import grand_total, with_group_total
from starledger.plans import views
from starledger.session import cut_lineage
from starledger.sources.star import SalesModel


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL column to DOUBLE (exact values are converted once, at the end)."""
    return df.select(
        *[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields]
    )


def _preinv_detail(m: SalesModel, fy: int, customer_code: int | None, with_keys: bool) -> DataFrame:
    """Sales of a year meet discounts by customer first, then prices and products, which meet each other by product:
    rows with product names and prices aren't exchanged again."""
    s = m.fact_sales_monthly.select("date", "fiscal_year", "product_code", "customer_code", "sold_quantity")
    s = s.filter(F.col("fiscal_year") == fy)
    if customer_code is not None:
        s = s.filter(F.col("customer_code") == customer_code)
    p = m.dim_product.select("product_code", "product", "variant")
    g = m.fact_gross_price.filter(F.col("fiscal_year") == fy).select("product_code", "gross_price")
    pre = m.fact_pre_invoice_deductions.filter(F.col("fiscal_year") == fy).select("customer_code", "pre_invoice_discount_pct")
    joined = s.join(pre, "customer_code").join(p.join(g, "product_code"), "product_code")
    keys = ["date", "fiscal_year", "customer_code"] if with_keys else ["date"]
    return joined.select(
        *keys, "product_code", "product", "variant", "sold_quantity",
        F.col("gross_price").alias("gross_price_per_item"),
        gross_line_total().alias("gross_price_total"),
        "pre_invoice_discount_pct",
    )


def preinv_detail_customer(m: SalesModel, customer_code: int, fy: int) -> DataFrame:
    return decimals_as_double(_preinv_detail(m, fy, customer_code, with_keys=False))


def preinv_detail_all(m: SalesModel, fy: int) -> DataFrame:
    return decimals_as_double(_preinv_detail(m, fy, None, with_keys=False))


def preinv_detail_dim_date(m: SalesModel, fy: int) -> DataFrame:
    """Same report resolving the fiscal year through the date dimension.

    ``dim_date`` has one row per calendar month (bounded by the calendar), so it
    is broadcast explicitly.
    """
    s = m.fact_sales_monthly.select("date", "product_code", "customer_code", "sold_quantity")
    dt = m.dim_date.select("calendar_date", "fiscal_year").filter(F.col("fiscal_year") == fy)
    p = m.dim_product.select("product_code", "product", "variant")
    g = m.fact_gross_price.select("product_code", "fiscal_year", "gross_price")
    pre = m.fact_pre_invoice_deductions.select("customer_code", "fiscal_year", "pre_invoice_discount_pct")
    joined = (
        s.join(F.broadcast(dt), s.date == dt.calendar_date)
        .join(p, "product_code")
        .join(g, ["product_code", "fiscal_year"])
        .join(pre, ["customer_code", "fiscal_year"])
    )
    return decimals_as_double(
        joined.select(
            "date", "fiscal_year", "customer_code", "product_code", "product", "variant", "sold_quantity",
            F.col("gross_price").alias("gross_price_per_item"),
            gross_line_total().alias("gross_price_total"),
            "pre_invoice_discount_pct",
        )
    )


def preinv_detail_fy_column(m: SalesModel, fy: int) -> DataFrame:
    return decimals_as_double(_preinv_detail(m, fy, None, with_keys=True))


def net_invoice_sales(m: SalesModel, fy: int) -> DataFrame:
    d = _preinv_detail(m, fy, None, with_keys=True).drop("fiscal_year")
    return decimals_as_double(
        d.select("*", ((F.lit(1) - F.col("pre_invoice_discount_pct")) * F.col("gross_price_total")).alias("net_invoice_sales"))
    )


def view_sales_preinv_discount(m: SalesModel) -> DataFrame:
    return decimals_as_double(views.sales_preinv_discount(m))


def net_invoice_sales_from_view(m: SalesModel) -> DataFrame:
    v = views.sales_preinv_discount(m)
    return decimals_as_double(
        v.select("*", (F.col("gross_price_total") - F.col("pre_invoice_discount_pct") * F.col("gross_price_total")).alias("net_invoice_sales"))
    )


def view_sales_postinv_discount(m: SalesModel) -> DataFrame:
    return decimals_as_double(views.sales_postinv_discount(m))


def net_sales_report(m: SalesModel) -> DataFrame:
    return decimals_as_double(views.net_sales(m))


def view_net_sales(m: SalesModel) -> DataFrame:
    return decimals_as_double(views.net_sales(m))


def top_n_markets_net_sales(m: SalesModel, fy: int, n: int) -> DataFrame:
    agg = views.net_sales(m, fy).groupBy("market").agg(mln_units(F.sum("net_sales")).alias("_u"))
    out = agg.select("market", (F.col("_u").cast("double") / 100.0).alias("net_sales_mln"), "_u")
    return top_n(out, [F.col("_u").desc(), F.col("market")], n).drop("_u")


def _net_sales_by_customer(m: SalesModel, fy: int, market: str | None = None, with_region: bool = False, ignore_case: bool = False) -> DataFrame:
    keys = ["customer", "region"] if with_region else ["customer"]
    ns = views.net_sales(m, fy, *keys)
    if market is not None:
        ns = ns.filter(same_text("market", market, ignore_case))
    return ns.groupBy(*keys).agg(mln_units(F.sum("net_sales")).alias("_u"))


def top_n_customers_net_sales(m: SalesModel, market: str, fy: int, n: int, ignore_case: bool = False) -> DataFrame:
    agg = _net_sales_by_customer(m, fy, market, ignore_case=ignore_case)
    out = agg.select("customer", (F.col("_u").cast("double") / 100.0).alias("net_sales_mln"), "_u")
    return top_n(out, [F.col("_u").desc(), F.col("customer")], n).drop("_u")


def customer_pct_net_sales(m: SalesModel, fy: int) -> DataFrame:
    """Share of each customer in the total of the *rounded* million figures."""
    # The aggregate feeds both the rows and the total: store it once (one row per
    # customer) instead of running the waterfall twice.
    agg = cut_lineage(_net_sales_by_customer(m, fy))
    total = grand_total(agg, "_u")
    return agg.select(
        "customer",
        (F.col("_u").cast("double") / 100.0).alias("net_sales_mln"),
        double_ratio(F.col("_u"), total, 100).alias("pct_net_sales"),
    ).orderBy(F.col("net_sales_mln").desc(), F.col("customer"))


def _region_shares(m: SalesModel, fy: int, pct_col: str) -> DataFrame:
    agg = cut_lineage(_net_sales_by_customer(m, fy, with_region=True))
    return with_group_total(agg, "_u", ["region"], "_ru").select(
        "customer", "region",
        (F.col("_u").cast("double") / 100.0).alias("net_sales_mln"),
        double_ratio(F.col("_u"), F.col("_ru"), 100).alias(pct_col),
    )


def customer_pct_by_region(m: SalesModel, fy: int) -> DataFrame:
    return _region_shares(m, fy, "pct_share_region").orderBy("region", F.col("pct_share_region").desc(), "customer")


def region_net_sales_breakdown(m: SalesModel, fy: int) -> DataFrame:
    return _region_shares(m, fy, "pct").orderBy("region", F.col("net_sales_mln").desc(), "customer")


def top_n_products_per_division(m: SalesModel, fy: int, n: int) -> DataFrame:
    s = m.fact_sales_monthly.select("product_code", "fiscal_year", "sold_quantity").filter(F.col("fiscal_year") == fy)
    p = m.dim_product.select("product_code", "division", "product")
    agg = s.join(p, "product_code").groupBy("division", "product").agg(F.sum("sold_quantity").alias("total_qty"))
    return top_n_per_group(agg, ["division"], [F.col("total_qty").desc()], n, rank_col="drnk")


def view_gross_sales(m: SalesModel) -> DataFrame:
    return decimals_as_double(views.gross_sales(m))


def top_n_products_net_sales(m: SalesModel, fy: int, n: int) -> DataFrame:
    # The view already carries the product name of dim_product.
    agg = views.net_sales(m, fy).groupBy("product").agg(mln_units(F.sum("net_sales")).alias("_u"))
    out = agg.select("product", (F.col("_u").cast("double") / 100.0).alias("net_sales_mln"), "_u")
    return top_n(out, [F.col("_u").desc(), F.col("product")], n).drop("_u")


def top_n_markets_per_region_gross(m: SalesModel, fy: int, n: int) -> DataFrame:
    agg = views.gross_sales(m, fy, "region").groupBy("market", "region").agg(mln_units(F.sum("gross_price_total")).alias("_u"))
    ranked = top_n_per_group(agg, ["region"], [F.col("_u").desc()], n, rank_col="drnk")
    return ranked.select("market", "region", (F.col("_u").cast("double") / 100.0).alias("gross_sales_mln"), "drnk")

