"""Summarise stage times from a Spark event-log folder (bench.py with BENCH_EVENT_LOG).

Usage: python tools/stage_times.py EVENT_LOG_DIR [top_n]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def stages(folder: str) -> list[tuple[float, int, str]]:
    files = [f for f in glob.glob(os.path.join(folder, "**", "*"), recursive=True) if os.path.isfile(f)]
    out = []
    for path in sorted(files):
        for line in _lines(path):
            if '"SparkListenerStageCompleted"' not in line:
                continue
            info = json.loads(line)["Stage Info"]
            ms = info.get("Completion Time", 0) - info.get("Submission Time", 0)
            out.append((ms / 1000.0, info["Number of Tasks"], info["Stage Name"].split("\n")[0][:80]))
    return out


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = stages(folder)
    print(f"{len(rows)} stages, {sum(r[0] for r in rows):.1f} s in total")
    for sec, tasks, name in sorted(rows, reverse=True)[:top]:
        print(f"{sec:8.2f} s  {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
