"""Shuffles start with partitions that follow the tables' rows, not the session's default alone."""

import datetime as dt

import pytest

from starledger import session
from starledger.plans import finance, views
from starledger.session import size_shuffles
from starledger.sources.star import build_star

KEYS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.fixture
def settings(spark):
    before = {key: spark.conf.get(key, None) for key in KEYS}
    yield spark.conf
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_partitions_follow_the_rows(spark, settings):
    settings.set(KEYS[0], 8)
    settings.unset(KEYS[1])
    size_shuffles(spark, 1000)
    assert (settings.get(KEYS[0]), settings.get(KEYS[1], None)) == ("8", None)
    size_shuffles(spark, 36_000_000)
    assert (settings.get(KEYS[0]), settings.get(KEYS[1])) == ("275", session.MERGED_BYTES)
    size_shuffles(spark, 1 << 50)
    assert settings.get(KEYS[0]) == str(session.MOST_SHUFFLED)


def test_what_the_session_names_stays(spark, settings):
    settings.set(KEYS[0], 5000)
    settings.set(KEYS[1], "256m")
    size_shuffles(spark, 36_000_000)
    assert (settings.get(KEYS[0]), settings.get(KEYS[1])) == ("5000", "256m")


def test_a_star_build_and_its_reports_are_cut_by_rows(spark, settings, tmp_path, monkeypatch):
    settings.set(KEYS[0], 4)
    monkeypatch.setattr(session, "SHUFFLE_ROWS", 10)
    tables = {
        "region": [(0, "R0")],
        "nation": [(0, "N0", 0)],
        "customer": [(k, 0, "SEG") for k in range(5)],
        "part": [(k, f"a{k} b{k} c{k}", "brand", "type", 1, 10.0 + k) for k in range(7)],
        "orders": [(k, k % 5, dt.datetime(1996, 1 + k % 12, 3)) for k in range(50)],
        "lineitem": [(k % 50, k % 7, 1.0 + k % 3, 0.05, 0.02) for k in range(200)],
    }
    columns = {
        "region": "r_regionkey int, r_name string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
        "lineitem": "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double",
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, columns[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    star = build_star(spark, str(tmp_path), f"{tmp_path}/star")
    assert settings.get(KEYS[0]) == "20"  # 200 rows
    plan = finance.monthly_gross_sales_customers(star, (1, 2))._jdf.queryExecution().toString()
    assert ", 20)" in plan and ", 4)" not in plan
    assert views.net_sales(star).agg({"sold_quantity": "sum"}).first()[0] == sum(row[2] for row in tables["lineitem"])


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_build_leaves_neither_shuffle_files_nor_the_grain(spark, settings, tmp_path):
    mode, before = spark.conf.get(session.FREED, None), _shuffle_files(spark)
    build_star(spark, "/root/testdata/sf0.001", f"{tmp_path}/star")
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(session.FREED, None) == mode
    assert not (tmp_path / "star" / "_sales_grain").exists() and (tmp_path / "star" / "market_months").exists()


def test_the_setting_comes_back_after_an_error(spark):
    mode = spark.conf.get(session.FREED, None)
    with pytest.raises(ZeroDivisionError), session.shuffles_freed(spark):
        assert spark.conf.get(session.FREED) == "true"
        1 / 0
    assert spark.conf.get(session.FREED, None) == mode
