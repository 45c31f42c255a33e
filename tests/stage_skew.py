"""Task-time spread per stage, from Spark's event log, for queries on a table.

Usage: ``python tests/stage_skew.py <dir with events.parquet> [key ...]``
   or: ``python tests/stage_skew.py --log <event log> ...``

Runs each registered query once with event logging to a fresh scratch
folder, then reads the log: for every stage with several tasks it reports
the longest task against the median task.  A stage where one task holds a
hot key would show max >> median.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage_spread(log_path: str) -> list[tuple[int, int, float, float]]:
    # A rolling event log is a folder of parts; a plain one is a single file.
    parts = sorted(glob.glob(os.path.join(log_path, "events_*"))) if os.path.isdir(log_path) else [log_path]
    tasks: dict[int, list[float]] = {}
    for part in parts:
        with open(part) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    info = ev["Task Info"]
                    ms = info["Finish Time"] - info["Launch Time"]
                    tasks.setdefault(ev["Stage ID"], []).append(ms)
    out = []
    for stage, times in sorted(tasks.items()):
        if len(times) >= 4:
            out.append((stage, len(times), max(times), statistics.median(times)))
    return out


def report(log: str) -> None:
    worst = 0.0
    for stage, n, mx, med in stage_spread(log):
        ratio = mx / med if med else float("inf")
        worst = max(worst, ratio if med >= 20 else 0.0)  # ignore stages of near-empty tasks
        print(f"stage {stage:3d}: {n:3d} tasks, max {mx:6.0f} ms, median {med:6.0f} ms")
    print(f"largest max/median over stages with median >= 20 ms: {worst:.1f}")


def main(argv):
    if argv[1] == "--log":  # an existing event log, e.g. from BENCH_EVENT_LOG_DIR
        for log in argv[2:]:
            report(log)
        return

    import __spark_entry__ as E
    from shopflow.session import build_session

    data_dir = argv[1]
    keys = argv[2:] or ["uv_by_date", "arpu_by_date", "repurchase_gap_lists", "buy_count_by_user"]
    log_dir = tempfile.mkdtemp(prefix="eventlog-")
    spark = build_session(
        "local[8]",
        conf={
            "spark.sql.shuffle.partitions": "32",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",  # keep every task visible
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": log_dir,
            "spark.eventLog.compress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key in keys:
        E.queries()[key](spark, data_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    report(glob.glob(os.path.join(log_dir, "*"))[0])


if __name__ == "__main__":
    main(sys.argv)
