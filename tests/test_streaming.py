"""The maintained act-est table and the session-log table."""

import datetime as dt

import pytest

from starledger.plans import supply
from starledger.sources.logs import RAW_LOG_SCHEMA
from starledger.sources.star import load_star, write_star
from starledger.streaming import purge
from starledger.streaming.catalog import act_est_upsert_actuals, act_est_upsert_forecast
from starledger.streaming.upsert import ActEstTable, replay

from conftest import SF_TINY
from helpers import D


def _rows(df):
    return sorted(tuple(r) for r in df.select(*supply.ACT_EST_COLS).collect())


def _changes(spark, rows, column="sold_quantity"):
    return spark.createDataFrame(rows, f"date date, product_code long, customer_code long, {column} long, ingest_seq long")


def _files(path):
    return sorted(p for p in path.rglob("*.parquet"))


def test_replay_of_both_streams_equals_rebuild(spark, tiny_model):
    expect = _rows(supply.integrate_act_est(tiny_model.fact_sales_monthly, tiny_model.fact_forecast_monthly))
    assert _rows(act_est_upsert_actuals(spark, SF_TINY)) == expect
    assert _rows(act_est_upsert_forecast(spark, SF_TINY)) == expect


def test_interleaved_small_batches_equal_rebuild(spark, tiny_model):
    sales = tiny_model.fact_sales_monthly.filter("customer_code % 7 = 1")
    plan = tiny_model.fact_forecast_monthly.filter("customer_code % 7 = 1")
    feeds = [(sales.filter("product_code % 2 = 0"), "sold_quantity"), (plan, "forecast_quantity"), (sales.filter("product_code % 2 = 1"), "sold_quantity")]
    assert _rows(replay(spark, feeds, files_per_batch=1)) == _rows(supply.integrate_act_est(sales, plan))


def test_sequence_numbers_decide_between_changes(spark, tmp_path):
    table = ActEstTable(spark, str(tmp_path / "t"))
    jan = D(2021, 1, 1)
    table.upsert(_changes(spark, [(jan, 1, 1, 5, 1), (jan, 1, 1, 7, 10), (jan, 1, 1, 6, 2), (jan, 2, 1, 4, 4)]), "sold_quantity")
    table.upsert(_changes(spark, [(jan, 1, 1, 3, 2), (jan, 2, 1, None, 5)]), "sold_quantity")  # late; null counts as 0
    table.upsert(_changes(spark, [(jan, 1, 1, 9, 0)], "forecast_quantity"), "forecast_quantity")
    assert _rows(table.read()) == [(jan, 2021, 1, 1, 7, 9), (jan, 2021, 2, 1, 0, 0)]
    table.upsert(_changes(spark, []), "sold_quantity")
    assert _rows(table.read()) == [(jan, 2021, 1, 1, 7, 9), (jan, 2021, 2, 1, 0, 0)]


def test_a_batch_that_runs_twice_changes_nothing_and_a_crash_before_the_overwrite_neither(spark, tmp_path, monkeypatch):
    table = ActEstTable(spark, str(tmp_path / "t"))
    jan, sep = D(2021, 1, 1), D(2021, 9, 1)
    first = _changes(spark, [(jan, 1, 1, 5, 1), (sep, 2, 1, 4, 2)])
    table.upsert(first, "sold_quantity")
    once = _rows(table.read())
    assert once == [(jan, 2021, 1, 1, 5, 0), (sep, 2022, 2, 1, 4, 0)]
    table.upsert(first, "sold_quantity")
    assert _rows(table.read()) == once
    second = _changes(spark, [(jan, 1, 1, 8, 3)])
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ActEstTable, "_write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        table.upsert(second, "sold_quantity")
    assert _rows(table.read()) == once
    table.upsert(second, "sold_quantity")
    assert (jan, 2021, 1, 1, 8, 0) in _rows(table.read()) and len(_rows(table.read())) == 2


def test_a_batch_of_one_month_rewrites_that_month_only(spark, tmp_path):
    table = ActEstTable(spark, str(tmp_path / "t"))
    table.upsert(_changes(spark, [(D(2021, m, 1), p, 1, 1, 0) for m in range(1, 13) for p in range(20)]), "sold_quantity")
    before = set(_files(tmp_path / "t"))
    table.upsert(_changes(spark, [(D(2021, 3, 1), p, 1, 2, 1) for p in range(25)]), "sold_quantity")
    after = set(_files(tmp_path / "t"))
    assert {f.parent.name for f in before ^ after} == {"date=2021-03-01"}
    assert table.read().count() == 11 * 20 + 25


def test_a_month_is_cut_by_its_size(spark, tmp_path):
    """A month with most rows is written by most tasks."""
    hot = spark.range(20_000).selectExpr("date'2021-03-01' as date", "id as product_code", "id % 50 as customer_code", "1L as sold_quantity", "id as ingest_seq")
    rest = spark.range(500).selectExpr("date'2021-04-01' as date", "id as product_code", "1L as customer_code", "1L as sold_quantity", "id as ingest_seq")
    table = ActEstTable(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.upsert(hot.union(rest), "sold_quantity")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in _files(tmp_path / "t") if f.parent.name == "date=2021-03-01"]) >= 6


def test_reports_see_an_upsert(spark, tiny_model, tmp_path):
    path = str(tmp_path / "star")
    write_star(tiny_model, path)
    model = load_star(spark, path)
    row = model.fact_act_est.filter("fiscal_year = 1997 and forecast_quantity > 0").orderBy("customer_code", "product_code", "date").first()

    def sold(m):
        r = supply.forecast_accuracy(supply.act_est(m, [1997]), m.dim_customer, 1997).filter(f"customer_code = {row.customer_code}").first()
        return r.total_sold_qty

    before = sold(model)
    change = _changes(spark, [(row.date, row.product_code, row.customer_code, row.sold_quantity + 1000, 1)])
    ActEstTable(spark, f"{path}/fact_act_est").upsert(change, "sold_quantity")
    assert sold(load_star(spark, path)) == before + 1000


def test_log_table(spark, tmp_path):
    rows = [(f"2022-10-{d:02d} 08:14:07", str(d), "5", f"EVENT {d}") for d in (4, 14, 16, 22)] + [("2022-10-22 18:10:06", "x", None, "EVENT 22"), ("not a time", "1", "1", "EVENT ?")]
    raw = spark.createDataFrame(rows, RAW_LOG_SCHEMA)
    target = str(tmp_path / "logs")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        purge.append_logs(raw, target, 0)
        purge.append_logs(raw, target, 0)  # the same batch again
        purge.append_logs(raw.limit(1), target, 1)
        assert purge.read_logs(spark, target).count() == 7
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    purge.create_log_table(spark, target, "session_logs_test")
    named = lambda: sorted(r.log for r in spark.sql("SELECT log FROM session_logs_test").collect())
    assert len(named()) == 7
    assert purge.purge_logs(spark, target, dt.date(2022, 10, 22), 6) == 2
    left = ["EVENT 16", "EVENT 22", "EVENT 22", "EVENT ?"]
    assert sorted(r.log for r in purge.read_logs(spark, target).collect()) == left
    purge.refresh_log_table(spark, "session_logs_test")
    assert named() == left
    spark.sql("DROP TABLE session_logs_test")


def test_log_stream_purges_as_of_each_batch(spark, tmp_path):
    rows = [(f"2022-10-{d:02d} 08:14:07", str(d), "5", f"EVENT {d}") for d in (4, 14, 16, 22)]
    src, target, days = str(tmp_path / "src"), str(tmp_path / "logs"), iter([dt.date(2022, 10, 10), dt.date(2022, 10, 22)])
    frame = spark.createDataFrame(rows, RAW_LOG_SCHEMA)
    frame.limit(2).coalesce(1).write.parquet(src)
    purge.run_log_stream(spark, src, target, str(tmp_path / "ckpt"), 7, lambda: next(days))
    assert sorted(r.log for r in purge.read_logs(spark, target).collect()) == ["EVENT 14", "EVENT 4"]
    frame.filter("session_id > 14").coalesce(1).write.mode("append").parquet(src)
    purge.run_log_stream(spark, src, target, str(tmp_path / "ckpt"), 7, lambda: next(days))
    assert sorted(r.log for r in purge.read_logs(spark, target).collect()) == ["EVENT 16", "EVENT 22"]
