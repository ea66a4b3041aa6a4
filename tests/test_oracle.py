"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools_compare import compare_frames

from conftest import SF_TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_TINY}/{t}.parquet')")
    return con


def test_every_report_has_oracle_sql():
    from starledger.plans.catalog import REPORTS
    from starledger.streaming.catalog import STREAM_REPORTS

    reports = set(REPORTS) | set(STREAM_REPORTS)
    assert reports <= set(E.oracle_sql()) <= set(E.queries())
    assert len(reports) == 84


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["market", "net_sales_mln"] and df.count() == 5


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_TINY)
    rel = duck.execute(E.oracle_sql()[key])
    result = compare_frames(sdf, rel)
    assert result["ok"], result
