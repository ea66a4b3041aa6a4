"""Physical-plan checks: no Python UDFs, pushdown and pruning on the stored star."""

import pytest

from conftest import SF_TINY

from starledger.plans import finance, revenue, supply
from starledger.plans.catalog import P, REPORTS
from starledger.sources.star import materialize_star

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_no_python_in_plan(spark, tiny_model, key):
    plan = _plan(REPORTS[key](spark, SF_TINY, tiny_model))
    assert not any(n in plan for n in PY_NODES), key


def _windows_fed_by_single_partition(plan: str) -> list[str]:
    """Window nodes whose input exchange (first Exchange below them) is SinglePartition."""
    lines = plan.split("\n")
    bad = []
    for i, line in enumerate(lines):
        if "Window [" not in line:
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        for below in lines[i + 1:]:
            if len(below) - len(below.lstrip(" :+-")) <= indent:
                break
            if "Exchange" in below:
                if "SinglePartition" in below:
                    bad.append(line.strip()[:120])
                break
    return bad


def test_no_single_partition_window(spark, tiny_model):
    keys = ("customer_pct_net_sales", "customer_pct_by_region", "region_net_sales_breakdown",
            "adv_customer_segments", "fm_category_sales_pct", "top3_products_per_division", "adv_category_pairs")
    for key in keys:
        plan = _plan(REPORTS[key](spark, SF_TINY, tiny_model))
        assert _windows_fed_by_single_partition(plan) == [], key


def test_top_n_per_group_uses_window_group_limit(spark, tiny_model):
    for key in ("top3_products_per_division", "top2_markets_per_region_gross", "cmp_top_markets_by_region"):
        plan = REPORTS[key](spark, SF_TINY, tiny_model)._jdf.queryExecution().optimizedPlan().toString()
        assert "WindowGroupLimit" in plan, key


@pytest.fixture(scope="module")
def stored(spark, tiny_model):
    return materialize_star(spark, tiny_model)


def test_stored_star_pushes_filters_and_prunes(spark, stored):
    plan = _plan(finance.customer_fy_transactions(stored, P.customer_code, P.fiscal_year))
    assert "EqualTo(customer_code,5)" in plan
    assert "GreaterThanOrEqual(date,1997-09-01)" in plan and "LessThan(date,1998-09-01)" in plan
    assert "(fiscal_year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    plan = _plan(revenue.preinv_detail_all(stored, P.fiscal_year))
    assert plan.count("= 1998)") >= 3  # sales, price and deductions all pruned to one fiscal year
    acc = _plan(supply.forecast_accuracy(supply.act_est(stored, [P.fiscal_year]), stored.dim_customer, P.fiscal_year))
    assert any("(fiscal_year#" in part.split("]")[0] for part in acc.split("PartitionFilters: [")[1:])
    # The ReadSchema of a narrow report lists only the columns it needs.
    plan = _plan(finance.market_badge(stored, P.fiscal_year, P.market, P.badge_threshold))
    assert "ReadSchema: struct<date:date,customer_code:bigint,sold_quantity:int>" in plan
    assert "EqualTo(market,NATION_2)" in plan


def test_stored_star_gives_same_results(spark, tiny_model, stored):
    for key in ("top5_markets_net_sales", "forecast_accuracy_rounded", "adv_customer_segments", "fm_category_sales_pct"):
        a = sorted(map(tuple, REPORTS[key](spark, SF_TINY, tiny_model).collect()))
        b = sorted(map(tuple, REPORTS[key](spark, SF_TINY, stored).collect()))
        assert a == b, key


def _physical(spark, build):
    """The plan of ``build()`` when nothing is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().sparkPlan().toString(), build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_churn_and_at_risk_join_reduced_sales(spark, stored):
    """Sales are reduced to a row per customer before they are exchanged."""
    from starledger.plans import advanced

    for build in (lambda: advanced.adv_churn_rate(stored, P.market), lambda: advanced.adv_at_risk_customers(stored, P.market, P.as_of)):
        _, plan = _physical(spark, build)
        for part in plan.split("Exchange hashpartitioning(customer_code")[1:]:
            below = part.split("\n")[1]
            assert "fact_sales_monthly" not in part.split("HashAggregate")[0] or "HashAggregate" in below


def _above(plan, table):
    """The names of the plan nodes above the scan of ``table``, from below."""
    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    above, out = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < above:
            above = depth(line)
            out.append(line.lstrip(" :+-*0123456789()"))
    return out


def test_the_waterfall_joins_the_facts_without_an_exchange(spark, stored):
    """Sales and deductions are bucketed by the keys of their join: no exchange below it, nothing broadcast.
    The fact then meets two small sides: prices with products, discounts with customers."""
    for build in (lambda: revenue.top_n_customers_net_sales(stored, P.market, P.fiscal_year, 5), lambda: revenue.net_sales_report(stored)):
        _, plan = _physical(spark, build)
        for table in ("sales_by_key", "fact_post_invoice_deductions"):
            above = _above(plan, table)
            join = next(i for i, node in enumerate(above) if "Join" in node)
            assert "SortMergeJoin [customer_code" in above[join] and not any("Exchange" in node for node in above[:join])
        assert sum("Join" in node for node in _above(plan, "sales_by_key")) == 3
    one_year = _physical(spark, lambda: revenue.top_n_markets_net_sales(stored, P.fiscal_year, 5))[1]
    assert one_year.count("PartitionFilters: [isnotnull(fiscal_year") >= 2


def test_another_session_reads_the_bucketed_tables(spark, stored, tiny_model, tmp_path):
    """The catalogue of a session that didn't write the star learns the buckets from its layout."""
    from starledger.sources import star

    path = str(tmp_path / "star")
    star.write_star(tiny_model, path)
    for t in ("sales_by_key", "fact_post_invoice_deductions"):
        spark.sql(f"DROP TABLE {star._catalogue_name(path, t)}")
    again = star.load_star(spark, path)
    _, plan = _physical(spark, lambda: revenue.net_sales_report(again))
    assert not any("Exchange" in node for node in _above(plan, "sales_by_key")[:3])
    assert revenue.net_sales_report(again).count() == revenue.net_sales_report(tiny_model).count()
    assert star.buckets_for(0) == star.LEAST_BUCKETS and star.buckets_for(10**14) == star.MOST_BUCKETS and star.buckets_for(10**9) == 128


def test_buckets_hold_few_rows_before_they_grow():
    """A task sorts a whole bucket: 36 million rows in 8 of them did not fit a heap of 1 GB."""
    from starledger.sources import star

    assert star.buckets_for(600_000) == star.LEAST_BUCKETS
    for rows in (9_000_000, 36_000_000, 100_000_000):
        assert rows / star.buckets_for(rows) <= star.BUCKET_ROWS
    assert star.buckets_for(10**8) == star.buckets_for(10**9) == star.SMALL_BUCKETS


def test_a_market_filter_prunes_row_groups(spark, tmp_path):
    """Sales lie by market: a market's report reads a small share of the row groups of a year."""
    import pyarrow.parquet as pq

    from starledger.plans import market
    from starledger.sources import star

    spark.conf.set("parquet.block.size", "16384")
    try:
        stored = star.build_star(spark, "/root/testdata/sf0.01", str(tmp_path / "star"))
    finally:
        spark.conf.unset("parquet.block.size")
    plan = market.fm_top_customers_revenue(stored, P.market)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo({star.MARKET_COLUMN},{P.market})" in plan
    groups = hit = 0
    for f in (tmp_path / "star" / "fact_sales_monthly").rglob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == star.MARKET_COLUMN)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            groups, hit = groups + 1, hit + (s.min <= P.market <= s.max)
    assert groups >= 100 and hit <= 0.25 * groups


def test_large_tables_are_not_broadcast(spark, tiny_model, tmp_path, monkeypatch):
    """Compressed files say little about the rows a driver would hold: tables with many rows are merged, though
    their files are under Spark's limit for broadcasts; those with few are still broadcast."""
    from starledger.plans import supply
    from starledger.plans.summary import build_market_months
    from starledger.plans.views import net_sales
    from starledger.sources import star

    def plans(m):
        frames = [build_market_months(m), net_sales(m, P.fiscal_year), supply.forecast_accuracy(m.fact_act_est, m.dim_customer, P.fiscal_year)]
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # above any file here, below the estimate of a join of two
        try:
            return [f._jdf.queryExecution().sparkPlan().toString() for f in frames]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

    star.write_star(tiny_model, f"{tmp_path}/small")
    assert all("BroadcastHashJoin" in p for p in plans(star.load_star(spark, f"{tmp_path}/small")))
    monkeypatch.setattr(star, "BROADCAST_BYTES", 1000)
    star.write_star(tiny_model, f"{tmp_path}/large")
    large = star.load_star(spark, f"{tmp_path}/large")
    assert not any("Broadcast" in p for p in plans(large))
    for t in star.STAR_TABLES:
        tiny_model.tables()[t].write.parquet(f"{tmp_path}/plain/{t}")
    plain = star.load_star(spark, f"{tmp_path}/plain")
    assert not any("Broadcast" in p for p in plans(plain.replace(fact_act_est=large.fact_act_est)))
    assert sorted(map(tuple, net_sales(large).collect())) == sorted(map(tuple, net_sales(tiny_model).collect()))
    assert "BroadcastHashJoin" not in star.derive_sales_grain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()


def test_sales_are_exchanged_twice_at_most(spark, stored):
    """Rows of sales go by customer and by product; names and attributes join them last."""
    from starledger.plans.summary import build_market_months

    builds = {"net_invoice_sales": lambda: revenue.net_invoice_sales(stored, P.fiscal_year), "market months": lambda: build_market_months(stored)}
    for name, build in builds.items():
        _, plan = _physical(spark, build)
        above = _above(plan, "fact_sales_monthly")
        reduced = next((i for i, node in enumerate(above) if node.startswith(("HashAggregate", "ObjectHashAggregate"))), len(above))
        exchanges = [node for node in above[:reduced] if node.startswith("Exchange")]
        assert len(exchanges) <= 2, (name, exchanges)
        scans = [node for node in exchanges if "product_code" in node or "customer_code" in node]
        assert scans == exchanges and sum("Join" in node for node in above[:reduced]) <= 2, name
