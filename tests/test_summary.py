"""Customers counted from bitmaps and sketches of market months."""

import pytest
from pyspark.sql import functions as F

from starledger.plans import market, summary
from starledger.plans.catalog import P
from starledger.plans.views import revenue_star
from starledger.sources.star import materialize_star


@pytest.fixture(scope="module")
def stored(spark, tiny_model):
    return materialize_star(spark, tiny_model)


@pytest.mark.parametrize("keys", [["region"], ["market", "channel"], ["fiscal_year"], ["sub_zone", "platform", "date"]])
def test_bitmaps_count_as_distinct_does(spark, stored, keys):
    got = summary.by_group(stored.market_months, keys, keys).select(*keys, "customer_count", "_rev", "_n", "_quantity")
    want = revenue_star(stored).groupBy(*keys).agg(F.count_distinct("customer_code"), F.sum("rev"), F.count("rev"), F.sum("sold_quantity"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_any_code_is_counted(spark):
    """Negative, sparse and very large codes, in several ranges."""
    codes = [-(2**40), -32768, -1, 0, 1, 2, 32768, 32769, 10**15, 10**15 + 1]
    rows = spark.createDataFrame([(c, c % 2) for c in codes * 3], "customer_code long, g long")
    code = F.col("customer_code")
    months = rows.groupBy("g", F.bitmap_bucket_number(code).alias("code_range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("customers"), F.lit(1).alias("rev"), F.lit(1).alias("n"), F.lit(1).alias("quantity"))
    got = {r.g: r.customer_count for r in summary.by_group(months, ["g"], ["g"]).collect()}
    assert got == {g: sum(c % 2 == g for c in codes) for g in (0, 1)}


def test_sketches_are_close(spark, stored):
    for report in (lambda e: market.cmp_market_vs_rest(stored, P.market, e), lambda e: market.cmp_regions(stored, e), lambda e: market.cmp_channel_effectiveness(stored, e), lambda e: market.cmp_platform_effectiveness(stored, e)):
        exact, near = ({tuple(v for k, v in r.asDict().items() if k in ("market_group", "region", "market", "channel", "platform")): r.customer_count for r in report(e).collect()} for e in (True, False))
        assert exact.keys() == near.keys()
        assert all(abs(near[k] - exact[k]) <= max(1, 0.05 * exact[k]) for k in exact)


def test_days_from_bits(spark):
    rows = spark.createDataFrame([(i % 5, f"{1960 + i % 90}-0{1 + i % 9}-{10 + i % 17}") for i in range(3000)], "k int, d string").withColumn("d", F.col("d").cast("date"))
    got = {r.k: r.days for r in summary.distinct_days("d", rows, ["k"], "days").collect()}
    assert got == {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("d").alias("n")).collect()}


def test_reports_read_the_summary_not_the_fact(spark, stored):
    plan = market.cmp_regions(stored)._jdf.queryExecution().executedPlan().toString()
    assert "market_months" in plan and "fact_sales_monthly" not in plan
    other = stored.replace(dim_customer=stored.dim_customer.where("customer_code < 10"))
    assert other.market_months is None and other.sales_by_market is None


def test_months_hold_no_bitmaps(spark, stored):
    """A summary that is no larger than the (month, customer) pairs of the sales."""
    assert not [k for _, k in stored.market_months.dtypes if k == "binary"]
    assert stored.market_months.count() == stored.fact_sales_monthly.select("date", "customer_code").distinct().count()


def test_market_months_of_keys_that_repeat_or_lack(spark):
    """Each of several rows of a customer, product or price counts; sales without one of them don't."""
    from helpers import D, model

    customers = [(1, "c", "p", "ch", "M", "z", "R"), (1, "c", "p", "ch", "M", "z", "R"), (1, "c", "p", "ch", "N", "z", "R"), (2, "d", "p", "ch", None, "z", "R")]
    products = [(1, "d", "s", "c", "a", "v"), (2, "d", "s", "c", "b", "v"), (2, "d", "s", "c", "b", "w")]
    sales = [(D(1997, 10, 1), 1, 1, 5), (D(1997, 10, 1), 2, 1, 7), (D(1997, 10, 1), 2, 1, None), (D(1997, 11, 1), 1, 2, 3), (D(1997, 11, 1), 3, 2, 3), (D(1997, 11, 1), 1, 9, 3), (D(1997, 11, 1), None, None, 4)]
    m = model(spark, customers, products, sales, [(1, 1998, 2.5), (2, 1998, 1.5), (2, 1998, 4), (3, 1998, 9)])
    got = summary.build_market_months(m)
    want = revenue_star(m).groupBy("date", "fiscal_year", *summary.ATTRIBUTES, "customer_code").agg(F.sum("rev").alias("rev"), F.count("rev").alias("n"), F.sum("sold_quantity").alias("quantity"))
    assert got.dtypes == want.dtypes and got.count() == 3
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
