"""Dirty-variant audit counts at sf0.01 (FIXTURES.md section 5)."""

from conftest import SF_SMALL

from starledger.plans.catalog import REPORTS
from starledger.sources.star import derive_star


def test_dirty_variant_counts(spark):
    m = derive_star(spark, SF_SMALL)
    counts = {k: REPORTS[k](spark, SF_SMALL, m).count() for k in (
        "dq_null_customers", "dq_dup_customers", "dq_null_products", "dq_dup_products", "dq_null_sales", "dq_dup_sales",
        "dq_fill_customers", "dq_fill_products")}
    assert counts["dq_null_customers"] == 137 and counts["dq_dup_customers"] == 30
    assert counts["dq_null_products"] == 154 and counts["dq_dup_products"] == 50
    assert counts["dq_null_sales"] == 661 and counts["dq_dup_sales"] == 647
    assert counts["dq_fill_customers"] == 1530 and counts["dq_fill_products"] == 2050


def test_star_sizes_sf001(spark):
    m = derive_star(spark, SF_SMALL)
    from starledger.plans import supply

    act = supply.act_est(m)
    assert m.fact_sales_monthly.count() == 59_936
    assert m.fact_forecast_monthly.count() == 53_779
    assert act.count() == 65_802
    assert act.filter("sold_quantity = 0").count() == 5_866 and act.filter("forecast_quantity = 0").count() == 12_563
    assert m.dim_date.count() == 80 and m.fact_gross_price.count() == 14_000
    assert m.fact_pre_invoice_deductions.count() == 7_885
    assert m.dim_customer.filter("market = 'NATION_2'").count() == 74
