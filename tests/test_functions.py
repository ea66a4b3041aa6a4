import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from starledger.functions import exact_round_ratio, fiscal_year, fiscal_year_bounds, in_fiscal_year, mln, mln_units


def test_fiscal_year_boundary(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 8, 31),), (dt.date(2020, 9, 1),), (dt.date(2021, 1, 15),), (dt.date(2021, 8, 1),)], "d date"
    )
    got = [r.fy for r in df.select(fiscal_year("d").alias("fy")).collect()]
    assert got == [2020, 2021, 2021, 2021]


def test_fiscal_year_range_equals_function(spark):
    days = spark.range(0, 1200).select(F.date_add(F.lit(dt.date(2019, 1, 1)), F.col("id").cast("int")).alias("d"))
    for fy in (2019, 2020, 2021, 2022):
        a = days.filter(fiscal_year("d") == fy).count()
        b = days.filter(in_fiscal_year("d", fy)).count()
        assert a == b and a > 0
    assert fiscal_year_bounds(2021) == (dt.date(2020, 9, 1), dt.date(2021, 9, 1))


def test_leap_day_minus_one_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    assert df.select(F.add_months("d", -12).alias("x")).first().x == dt.date(2023, 2, 28)


def test_exact_round_ratio_half_away_from_zero(spark):
    rows = [(1, 8, 2), (-1, 8, 2), (1005, 1000, 2), (-1005, 1000, 2), (2, 3, 1), (5, 0, 2), (0, 7, 2), (1, 200, 2)]
    df = spark.createDataFrame(rows, "n long, d long, k int")
    got = [
        r.v
        for r in df.select(
            F.when(F.col("k") == 1, exact_round_ratio("n", "d", 1)).otherwise(exact_round_ratio("n", "d", 2)).alias("v")
        ).collect()
    ]
    # 1/8 = 0.125 -> 0.13; 1.005 -> 1.01 (exact, not binary 1.00499..); 1/200 = 0.005 -> 0.01
    assert got == [0.13, -0.13, 1.01, -1.01, 0.7, None, 0.0, 0.01]


def test_mln_rounding_is_exact(spark):
    df = spark.createDataFrame([(Decimal("1235000.0000"),), (Decimal("1234999.9999"),), (Decimal("-15000.0000"),)], "x decimal(20,4)")
    got = df.select(mln_units("x").alias("u"), mln("x").alias("m")).collect()
    assert [int(r.u) for r in got] == [124, 123, -2]
    assert [r.m for r in got] == [1.24, 1.23, -0.02]
