"""The schema audits find what was planted, and nothing in clean tables."""

import itertools

from starledger.operators.audits import Dependency, Edge, dependency_violations, orphans
from starledger.plans import quality
from starledger.sources.dirty import inconsistent_star, star_with_gaps


def test_dependencies(spark):
    t = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, None, 7), (2, "b", 7), (3, None, 8), (3, None, 8), (None, "x", 1), (None, "y", 2)], "k long, v string, w int")
    found = dependency_violations([Dependency("k -> v", t, ("k",), "v"), Dependency("k -> w", t, ("k",), "w"), Dependency("v, w -> k", t, ("v", "w"), "k")])
    assert sorted(map(tuple, found.collect())) == [("k -> v", "2", 2), ("k -> w", "1", 2)]


def test_orphans(spark):
    child = spark.createDataFrame([(1, 9), (1, 8), (2, 9), (4, 9), (4, 9), (None, 9)], "k long, j int")
    parent = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (None, 9)], "p long, j int")
    found = orphans([Edge("k", child, parent, ("k",), ("p",)), Edge("k, j", child, parent, ("k", "j"), ("p", "j"))])
    assert sorted(map(tuple, found.collect())) == [("k", "", 1), ("k", "4", 2), ("k, j", "1|8", 1), ("k, j", "4|9", 2), ("k, j", "|9", 1)]


def test_given_tables_are_clean_and_damaged_ones_are_not(spark, tiny_model):
    assert quality.dq_dependencies(tiny_model).where("dependency not like 'product ->%' and dependency not like 'sub_zone%'").count() == 0
    assert quality.dq_orphans(tiny_model).count() == 0
    damaged = {r.dependency for r in quality.dq_dependencies(inconsistent_star(tiny_model)).collect()}
    assert {"customer_code -> customer", "customer_code -> region", "customer_code -> sub_zone", "market -> region", "product_code -> division", "product_code, fiscal_year -> gross_price"} <= damaged
    edges = {r.edge for r in quality.dq_orphans(star_with_gaps(tiny_model)).collect()}
    assert len(edges) == 10


def test_one_shuffle(spark, tiny_model):
    """One exchange of the rows, reduced on the map side, and no join among the audited tables."""
    t = spark.range(100).selectExpr("id as k", "id % 7 as v")
    for df in (dependency_violations([Dependency("a", t, ("v",), "k"), Dependency("b", t, ("k",), "v")]), orphans([Edge("e", t, t.where("k > 3"), ("k",))])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1


def test_orphans_of_text_and_of_several_types(spark):
    """Keys are compared column by column, not by their joined text; integers of two widths and other types match."""
    child = spark.createDataFrame([("a|b", "c", 1, "7", None), ("x", "y", 2, "8", None), ("x", "y", 2, "8", None), (None, "", 3, "9", None), ("", None, 3, "9", None)], "s string, t string, i int, n string, none string")
    parent = spark.createDataFrame([("a", "b|c", 1, 7), ("x", "y", 3, 8), ("x", "y", None, 8)], "s string, t string, i long, n int")
    found = orphans([Edge("text", child, parent, ("s", "t")), Edge("integers", child, parent, ("i",)), Edge("text as number", child, parent, ("n",)), Edge("none", child, parent, ("none",), ("s",))])
    assert sorted(map(tuple, found.collect())) == [("integers", "2", 2), ("none", "", 5), ("text", "a|b|c", 1), ("text", "|", 1), ("text", "|", 1), ("text as number", "9", 2)]


def test_orphans_equal_those_of_plain_anti_joins(spark, tiny_model):
    star = star_with_gaps(tiny_model)
    found = {tuple(r) for r in quality.dq_orphans(star).where("edge = 'sales -> post-invoice deductions'").collect()}
    lost = star.fact_sales_monthly.join(star.fact_post_invoice_deductions, ["customer_code", "product_code", "date"], "left_anti")
    want = {("sales -> post-invoice deductions", f"{'' if r.customer_code is None else r.customer_code}|{r.product_code}|{r.date}", r["count"]) for r in lost.groupBy("customer_code", "product_code", "date").count().collect()}
    assert found == want and found


def test_keys_become_text_only_where_they_are_reported(spark):
    """What is exchanged has a fixed width, and no row is multiplied by the number of its rules."""
    t = spark.range(100).selectExpr("id as k", "cast(id % 7 as int) as v", "date'1997-01-01' as d")
    edges = [Edge("a", t, t.where("k > 3"), ("k",)), Edge("b", t, t.where("v > 3"), ("v", "d")), Edge("c", t, t, ("k", "v", "d"))]
    plan = orphans(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == len(edges)
    lines = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.split("\n")]
    for k, (depth, line) in enumerate(lines):
        below = itertools.takewhile(lambda x: x[0] > depth, lines[k + 1 :])
        assert "Exchange" not in line or not any("concat_ws" in text for _, text in below)
