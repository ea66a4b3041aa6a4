"""Write docs/PLANS.md: physical plans of representative reports over the stored star, as they are
when no table is small enough to broadcast (run: python tools/explain_plans.py [SF_DIR])."""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEYS = [
    ("top5_markets_net_sales", "net-sales waterfall: small sides joined first, three exchanges of the fact, TakeOrderedAndProject"),
    ("customer_pct_net_sales", "share of total: checkpointed aggregate + scalar subquery instead of SUM() OVER ()"),
    ("top3_products_per_division", "top-n per group: dense_rank with WindowGroupLimit"),
    ("forecast_accuracy_rounded", "accuracy over the stored fact_act_est: one fiscal-year partition scanned"),
    ("adv_category_pairs", "basket pairs: counts across ranges of a basket, RANGE windows within one, no self-join"),
    ("adv_churn_rate", "sales reduced to a row per customer before the join"),
    ("adv_customer_segments", "exact CUME_DIST cut-offs without a global window"),
    ("forecast_to_sales_ratio", "fan-out join pre-aggregated to (sum, count) per product-month"),
    ("customer_fy_transactions", "fiscal year as a pushed date range + partition filter"),
]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from starledger.plans.catalog import REPORTS
    from starledger.session import local_session
    from starledger.sources.star import build_star

    spark = local_session(os.environ.get("PLAN_CPUS", "8"), shuffle_partitions=16)
    spark.conf.set("spark.sql.maxMetadataStringLength", "200")
    model = build_star(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at a scale where nothing fits
    out = [
        "# Physical plans",
        "",
        f"Generated by `tools/explain_plans.py` over the star stored by `build_star` ({os.path.basename(sf)}, "
        "16 shuffle partitions, AQE on, automatic broadcasts off as at a scale where no table is small). "
        "Plans are before execution; AQE may still coalesce partitions, split skewed ones or switch joins.",
        "",
    ]
    for key, why in KEYS:
        df = REPORTS[key](spark, sf, model)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plan = buf.getvalue()
        out += [f"## {key}", "", why, "", "```", plan.strip(), "```", ""]
    path = os.path.join(ROOT, "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
