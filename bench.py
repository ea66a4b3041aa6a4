"""Benchmark: every report of the catalogue at $BENCH_SF_DIR on local[$BENCH_CPUS].

Protocol: the star is derived from the driver tables and materialised into
the shared checkpoint folder (``star_build``, the ETL step: one warm-up build,
then one timed build whose tables the reports read);
then each report runs over the stored star, one warm-up then the median of
``$BENCH_REPEAT`` (default 3) wall times, executed with the ``noop`` sink
(full execution, nothing collected). The two streaming upsert jobs run once,
over the same stored star. Prints ONE JSON line. Optional environment:
BENCH_KEYS (comma list), BENCH_REPEAT, BENCH_SHUFFLE, BENCH_EVENT_LOG (folder for
Spark's event log, to read stage and task times afterwards).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]

    from pyspark.sql import SparkSession

    builder = SparkSession.builder
    event_log = os.environ.get("BENCH_EVENT_LOG")  # optional: stage/task times for later analysis
    if event_log:
        os.makedirs(event_log, exist_ok=True)
        builder = (
            builder.config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", event_log)
            .config("spark.eventLog.compress", "false")
        )
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("starledger-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", os.environ.get("BENCH_CLEAN", "true"))
        # One shuffle partition per core at this data size (AQE coalesces further).
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", cpus if cpus.isdigit() else "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from starledger.plans.catalog import REPORTS
    from starledger.sources.star import build_star, star_for
    from starledger.streaming.catalog import STREAM_REPORTS

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    # Warm-up build (not timed), like every other key: JIT/codegen warm-up otherwise
    # doubles the first run.
    build_star(spark, sf_dir)

    t0 = time.perf_counter()
    model = star_for(spark, sf_dir)  # memoised: the streaming jobs reuse this stored star
    times["star_build"] = round(time.perf_counter() - t0, 3)

    keys = only or list(REPORTS)
    for key in keys:
        if key not in REPORTS:
            continue
        fn = REPORTS[key]
        run(fn(spark, sf_dir, model))  # warm-up
        samples = []
        for _ in range(repeat):
            t = time.perf_counter()
            run(fn(spark, sf_dir, model))
            samples.append(time.perf_counter() - t)
        times[key] = round(statistics.median(samples), 3)

    for key, fn in STREAM_REPORTS.items():
        if only and key not in only:
            continue
        t = time.perf_counter()
        run(fn(spark, sf_dir))
        times[key] = round(time.perf_counter() - t, 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_wall_time_all_reports",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cores": cpus,
                "spark": spark.version,
                "protocol": f"star_build: 1 warm-up + 1 timed; reports over the stored star: 1 warm-up + median of {repeat}; streaming jobs: 1 run",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
