"""Market months: sales by month, market attributes and customer.

A row holds the sums of a customer's month. Customers of any period or grouping are counted from bitmaps
(Spark's ``bitmap_construct_agg`` over the integer code) or a HyperLogLog sketch, made on the map side by that
grouping: no (group, customer) pair is shuffled. Bitmaps of single months would hold a few customers in 4 KB
each, many times the rows that they replace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.functions.money import revenue
from starledger.plans.views import priced_sales
from starledger.sources.star import SalesModel

ATTRIBUTES = ["market", "region", "sub_zone", "channel", "platform"]
#: Base-2 logarithm of a sketch's registers: a relative standard error of about 1.04 / 2 ** 6.
SKETCH_BITS = 12


def build_market_months(m: SalesModel) -> DataFrame:
    """(date, fiscal_year, attributes, customer_code, rev, n, quantity) of all sales with a customer, a product
    and a price. Sales are summed by customer and month before they meet the customers, so rows of sales are never
    exchanged with customers' attributes and a customer with much of the sales comes to the join as a few rows."""
    sold = priced_sales(m).withColumn("rev", revenue("sold_quantity", "gross_price")).groupBy("date", "fiscal_year", "customer_code").agg(
        F.sum("rev").alias("rev"),
        F.count("rev").alias("n"),
        F.sum("sold_quantity").alias("quantity"),
    )
    joined = sold.join(m.dim_customer.select("customer_code", *ATTRIBUTES), "customer_code")
    sums = [F.sum(c).cast(sold.schema[c].dataType).alias(c) for c in ("rev", "n", "quantity")]
    return joined.groupBy("date", "fiscal_year", *ATTRIBUTES, "customer_code").agg(*sums)


def market_months(m: SalesModel) -> DataFrame:
    """The stored table, or the same rows from the facts."""
    return m.market_months if m.market_months is not None else build_market_months(m)


def by_group(months: DataFrame, keys: Sequence[Column | str], names: Sequence[str], exact: bool = True) -> DataFrame:
    """(names, _rev, _n, _quantity, customer_count): totals of ``months`` by ``keys``; customers are counted
    by bitmaps, or estimated by sketches with ``exact=False``. ``months`` may hold bitmaps (code_range, customers)
    in place of customer codes."""
    keyed = [k.alias(n) if isinstance(k, Column) else k for k, n in zip(keys, names, strict=True)]
    sums = [F.sum(c).alias(f"_{c}") for c in ("rev", "n", "quantity")]
    code = F.col("customer_code")
    if not exact:
        estimate = F.hll_sketch_estimate(F.hll_sketch_agg(code, F.lit(SKETCH_BITS))).alias("customer_count")
        return months.groupBy(*keyed).agg(*sums, estimate)
    if "customers" in months.columns:
        ranges = months.groupBy(*keyed, "code_range").agg(*sums, F.bitmap_or_agg("customers").alias("_customers"))
    else:
        bits = F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("_customers")
        ranges = months.groupBy(*keyed, F.bitmap_bucket_number(code).alias("code_range")).agg(*sums, bits)
    again = [F.sum(f"_{c}").alias(f"_{c}") for c in ("rev", "n", "quantity")]
    return ranges.groupBy(*names).agg(*again, F.sum(F.bitmap_count("_customers")).alias("customer_count"))


def distinct_days(date: str, groups: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct dates of each key from bits of 64-day words: ``bit_or`` combines on the map side."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), day.bitwiseAND(63).cast("int"))
    words = groups.groupBy(*keys, F.shiftright(day, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return words.groupBy(*keys).agg(F.sum(F.bit_count("_bits")).cast("long").alias(name))
