"""D. Supply chain: actual-vs-forecast integration and forecast accuracy."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.constants import FULL_ACCURACY_PCT

from starledger.functions.dates import fiscal_year
from starledger.functions.money import double_ratio, exact_round_units
from starledger.session import shared_dir
from starledger.sources.act_est import integrate_act_est
from starledger.sources.logs import raw_logs_from_events
from starledger.sources.star import SalesModel
from starledger.streaming.purge import append_logs, purge_logs, read_logs

ACT_EST_COLS = ["date", "fiscal_year", "product_code", "customer_code", "sold_quantity", "forecast_quantity"]


def act_est(m: SalesModel, fiscal_years: Sequence[int] | None = None) -> DataFrame:
    """fact_act_est, optionally restricted to some fiscal years.

    A stored table is read with a partition filter. Otherwise it is derived;
    the fiscal year is a function of the join key ``date``, so the year filter
    is applied to both facts *before* the full outer join (Catalyst cannot push
    a filter on a computed column through a full outer join).
    """
    if m.fact_act_est is not None:
        act = m.fact_act_est.select(*ACT_EST_COLS)
        return act if fiscal_years is None else act.filter(F.col("fiscal_year").isin(list(fiscal_years)))
    s, f = m.fact_sales_monthly, m.fact_forecast_monthly
    if fiscal_years is not None:
        s = s.filter(F.col("fiscal_year").isin(list(fiscal_years)))
        f = f.filter(F.col("fiscal_year").isin(list(fiscal_years)))
    return integrate_act_est(s, f)


def act_est_typed(act: DataFrame) -> DataFrame:
    """Quantities as BIGINT NOT NULL: a NULL fails the job instead of passing silently."""
    def not_null(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("bigint"), F.raise_error(F.lit(f"{c} must not be NULL")).cast("bigint")).alias(c)

    return act.select("date", "fiscal_year", "product_code", "customer_code", not_null("sold_quantity"), not_null("forecast_quantity"))


def _error_sums(act: DataFrame, fy: int | Sequence[int]) -> DataFrame:
    """Per customer (and fiscal year, when several are given): quantity and error sums."""
    err = F.col("forecast_quantity") - F.col("sold_quantity")
    years = [fy] if isinstance(fy, int) else list(fy)
    keys = ["customer_code"] if isinstance(fy, int) else ["customer_code", "fiscal_year"]
    return act.filter(F.col("fiscal_year").isin(years)).groupBy(*keys).agg(
        F.sum("sold_quantity").alias("total_sold_qty"),
        F.sum("forecast_quantity").alias("total_forecast_qty"),
        F.sum(err).alias("net_err"),
        F.sum(F.abs(err)).alias("abs_err"),
    )


def _accuracy(pct: F.Column) -> F.Column:
    # IF(pct > 100, 0, 100 - pct); NULL pct (no forecast) stays NULL.
    return F.when(pct > FULL_ACCURACY_PCT, F.lit(0.0)).otherwise(F.lit(float(FULL_ACCURACY_PCT)) - pct)


def forecast_accuracy(act: DataFrame, dim_customer: DataFrame, fy: int) -> DataFrame:
    """Per customer: quantities, net/absolute error and their % of forecast, accuracy."""
    e = _error_sums(act, fy)
    c = dim_customer.select("customer_code", F.col("customer").alias("customer_name"), "market")
    out = e.join(c, "customer_code").select(
        "customer_code", "total_sold_qty", "total_forecast_qty",
        "net_err", double_ratio("net_err", "total_forecast_qty", 100).alias("net_err_pct"),
        "abs_err", double_ratio("abs_err", "total_forecast_qty", 100).alias("abs_err_pct"),
        "customer_name", "market",
    )
    return out.withColumn("forecast_accuracy", _accuracy(F.col("abs_err_pct"))).orderBy(
        F.col("forecast_accuracy").desc_nulls_last(), "customer_code"
    )


def forecast_accuracy_table(
    act: DataFrame, dim_customer: DataFrame, fy: int | Sequence[int], round_pct: bool = False
) -> DataFrame:
    """The temp-table variant: customer attributes first, then the error columns.

    With ``round_pct`` the net error % is rounded to 1 and the absolute error %
    to 2 decimals (exactly), and the accuracy is computed from the rounded value.
    With several fiscal years the rows are per (customer, fiscal_year) and carry
    a ``fiscal_year`` column — one aggregation for all years.
    """
    e = _error_sums(act, fy)
    c = dim_customer.select("customer_code", F.col("customer").alias("customer_name"), "market")
    j = e.join(c, "customer_code")
    if round_pct:
        net_pct = exact_round_units(F.col("net_err") * 100, "total_forecast_qty", 1)
        abs_units = exact_round_units(F.col("abs_err") * 100, "total_forecast_qty", 2)
        accuracy = F.when(abs_units > 10_000, F.lit(0.0)).otherwise((F.lit(10_000) - abs_units).cast("double") / 100.0)
        pct_cols = [
            (net_pct.cast("double") / 10.0).alias("net_error_pct"),
            (abs_units.cast("double") / 100.0).alias("abs_error_pct"),
        ]
    else:
        abs_pct = double_ratio("abs_err", "total_forecast_qty", 100)
        accuracy = _accuracy(abs_pct)
        pct_cols = [
            double_ratio("net_err", "total_forecast_qty", 100).alias("net_error_pct"),
            abs_pct.alias("abs_error_pct"),
        ]
    by_year = [] if isinstance(fy, int) else ["fiscal_year"]
    return j.select(
        "customer_code", *by_year, "customer_name", "market", "total_sold_qty", "total_forecast_qty",
        F.col("net_err").alias("net_error"), pct_cols[0],
        F.col("abs_err").alias("abs_error"), pct_cols[1],
        accuracy.alias("forecast_accuracy"),
    ).orderBy(F.col("forecast_accuracy").desc_nulls_last(), "customer_code", *by_year)


def forecast_accuracy_drop(act: DataFrame, dim_customer: DataFrame, fy_prev: int, fy_curr: int) -> DataFrame:
    """Customers whose (rounded) accuracy fell from ``fy_prev`` to ``fy_curr``.

    Both years come from one scan and one aggregation by (customer, fiscal_year);
    the two year slices of that result are joined on the customer.
    """
    both = forecast_accuracy_table(act, dim_customer, [fy_prev, fy_curr], round_pct=True)
    prev = both.filter(F.col("fiscal_year") == fy_prev).select(
        "customer_code", "customer_name", "market", F.col("forecast_accuracy").alias("forecast_acc_prev")
    )
    curr = both.filter(F.col("fiscal_year") == fy_curr).select(
        "customer_code", F.col("forecast_accuracy").alias("forecast_acc_curr")
    )
    return (
        prev.join(curr, "customer_code")
        .filter(F.col("forecast_acc_curr") < F.col("forecast_acc_prev"))
        .orderBy(F.col("forecast_acc_prev").desc(), "customer_code")
    )


def session_log_ingest(events: DataFrame) -> DataFrame:
    """Raw log rows (the events stand-in) typed and appended to a session-log table; the table."""
    target = shared_dir(events.sparkSession, "logs")
    append_logs(raw_logs_from_events(events), target, 0)
    return read_logs(events.sparkSession, target)


def session_log_purge(events: DataFrame, as_of: _dt.date, days: int) -> DataFrame:
    """The session-log table after a purge of the days older than ``as_of`` - ``days``."""
    target = shared_dir(events.sparkSession, "logs")
    append_logs(raw_logs_from_events(events), target, 0)
    purge_logs(events.sparkSession, target, as_of, days)
    return read_logs(events.sparkSession, target)
