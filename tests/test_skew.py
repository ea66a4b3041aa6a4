"""Operators stay exact when one key holds a third of all rows."""

import datetime as dt
import random
from fractions import Fraction

from pyspark.sql import functions as F

from starledger.operators import cume_dist_cutoffs, ordered_pair_counts, top_n_per_group, with_group_total

from test_operators import _brute_pairs


def _skewed_rows(seed=11, n=3000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0  # a third of the rows belong to customer 0 in one month
        c = 0 if hot else rnd.randint(1, 200)
        d = dt.date(2021, 1, 1) if hot else dt.date(2021, rnd.randint(1, 12), 1)
        p = i if hot else rnd.randint(0, 500)  # the hot basket holds 1000 distinct products
        rows.append((c, d, p, "cat%d" % (p % 7), rnd.randint(1, 50)))
    return rows


def test_pairs_with_hot_basket(spark):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "c long, d date, p long, a string, q int")
    got = {(r.x, r.y): r.frequency for r in ordered_pair_counts(df, ["c", "d"], "p", "a", "x", "y").collect()}
    assert got == _brute_pairs([(c, d, p, a) for c, d, p, a, _ in rows])


def test_cutoffs_and_shares_with_hot_customer(spark):
    rows = _skewed_rows(seed=12)
    df = spark.createDataFrame(rows, "c long, d date, p long, a string, q int")
    per_customer = df.groupBy("c").agg(F.sum("q").alias("spent"))
    cut80, cut50 = cume_dist_cutoffs(per_customer, "spent", [0.8, 0.5])
    got = per_customer.limit(1).select(cut80.alias("a"), cut50.alias("b")).first()
    spent = {}
    for c, _, _, _, q in rows:
        spent[c] = spent.get(c, 0) + q
    vals = sorted(spent.values())
    n = len(vals)

    def cut(p):
        return min(v for v in vals if Fraction(sum(1 for x in vals if x <= v), n) >= Fraction(p).limit_denominator())

    assert (got.a, got.b) == (cut(0.8), cut(0.5))
    shares = with_group_total(df, "q", ["d"], "t").groupBy("d").agg(F.sum(F.col("q") / F.col("t")).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in shares.collect())


def test_top_n_per_group_with_hot_group(spark):
    rows = _skewed_rows(seed=13)
    df = spark.createDataFrame(rows, "c long, d date, p long, a string, q int")
    out = top_n_per_group(df, ["c"], [F.col("q").desc()], 1, rank_col="r").filter(F.col("c") == 0).collect()
    best = max(q for c, _, _, _, q in rows if c == 0)
    assert {r.q for r in out} == {best} and len(out) == sum(1 for c, *_, q in rows if c == 0 and q == best)


def test_two_values_that_hold_most_of_one_basket_share_no_window(spark, monkeypatch):
    """A basket with most rows in two values: windows hold a range of it, not the basket."""
    from starledger.operators import pairs

    rows = spark.range(4000).selectExpr("1 as c", "id as p", "CASE WHEN id % 50 = 0 THEN 'x' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END as v")
    sizes = []
    real = pairs._earlier_partners

    def watched(part, group, attr):
        expanded = part.join(part.select(*group, attr).distinct().withColumnRenamed(attr, "_partner"), group).filter(f"{attr} <> _partner")
        sizes.append(expanded.groupBy(*group, F.least(attr, "_partner"), F.greatest(attr, "_partner")).count().agg({"count": "max"}).first()[0])
        return real(part, group, attr)

    monkeypatch.setattr(pairs, "_earlier_partners", watched)
    got = {(r.a, r.b): r.frequency for r in pairs.ordered_pair_counts(rows, ["c"], "p", "v", "a", "b", width=256).collect()}
    assert max(sizes) <= 256
    value = ["x" if i % 50 == 0 else "a" if i % 2 == 0 else "b" for i in range(4000)]
    want, seen = {}, {}
    for v in value:
        for other, n in seen.items():
            if other != v:
                want[other, v] = want.get((other, v), 0) + n
        seen[v] = seen.get(v, 0) + 1
    assert got == want


def test_sparse_codes_share_no_window(spark, monkeypatch):
    """One basket of codes that lie far apart: no window holds more than a digit's rows of two values."""
    from starledger.operators import pairs

    n, step = 6000, 4096 * 977
    rows = spark.range(n).selectExpr("1 as c", f"id * {step} - 5000000000 as p", "CASE WHEN id % 50 = 0 THEN 'x' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END as v")
    sizes = []
    real = pairs._earlier_partners

    def watched(part, group, attr):
        expanded = part.join(part.select(*group, attr).distinct().withColumnRenamed(attr, "_partner"), group).filter(f"{attr} <> _partner")
        sizes.append(expanded.groupBy(*group, F.least(attr, "_partner"), F.greatest(attr, "_partner")).count().agg({"count": "max"}).first()[0] or 0)
        return real(part, group, attr)

    monkeypatch.setattr(pairs, "_earlier_partners", watched)
    got = {(r.a, r.b): r.frequency for r in pairs.ordered_pair_counts(rows, ["c"], "p", "v", "a", "b").collect()}
    assert max(sizes) <= 1024 and len(sizes) == 4
    want, seen = {}, {}
    for i in range(n):
        v = "x" if i % 50 == 0 else "a" if i % 2 == 0 else "b"
        for other, k in seen.items():
            if other != v:
                want[other, v] = want.get((other, v), 0) + k
        seen[v] = seen.get(v, 0) + 1
    assert got == want
