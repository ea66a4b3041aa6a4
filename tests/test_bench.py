"""bench.py prints exactly one JSON line with the driver's fields."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_TINY


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_TINY, BENCH_CPUS="4", BENCH_KEYS="top5_markets_net_sales", BENCH_REPEAT="1")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=600, cwd=ROOT
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"star_build", "top5_markets_net_sales"}
    assert result["value"] > 0
