"""Write PLANS.md: the physical plan shape of every registered query.

For each key: the shuffles (exchange partitioning keys), broadcasts, the
filters pushed into each parquet scan and the columns each scan reads.
Run: ``python tests/plan_summary.py [sf_dir] > PLANS.md``.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _clean(s: str) -> str:
    return re.sub(r"#\d+L?", "", s).strip()


def summarize(text: str) -> dict:
    nodes = re.findall(r"^\((\d+)\) (.+?)\s*$", text, re.M)
    kinds = [n for _, n in nodes]
    shuffles = [
        _clean(m) for m in re.findall(r"Arguments: (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))", text)
    ]
    pushed = [_clean(p) for p in re.findall(r"PushedFilters: \[(.*?)\]\n", text)]
    schemas = [_clean(s) for s in re.findall(r"ReadSchema: (struct<.*?>)\n", text)]
    return {
        "exchanges": sum(1 for k in kinds if k.startswith("Exchange")),
        "shuffle_keys": [s.replace("hashpartitioning", "hash").split(", ENSURE")[0] for s in shuffles],
        "broadcast": sum(1 for k in kinds if k.startswith("BroadcastExchange")),
        "windows": sum(1 for k in kinds if k.startswith("Window")),
        "expand": any(k.startswith("Expand") for k in kinds),
        "pushed": [p for p in pushed if p],
        "read": schemas,
    }


def main(argv):
    from shopflow.plans.catalog import QUERIES
    from shopflow.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# PLANS\n")
    print(f"Physical plans of every query on action logs (`explain('formatted')`, {sf_dir}, AQE on,")
    print("before runtime re-planning). Generated by `tests/plan_summary.py`.")
    print("Broadcasts listed here are Spark's own, of sides under `autoBroadcastJoinThreshold` at this size.\n")
    print("| query | exchanges: partitioning | broadcast | window | expand | pushed filters | columns read |")
    print("|---|---|---|---|---|---|---|")
    for key, fn in QUERIES.items():
        s = summarize(formatted(fn(spark, sf_dir)))
        keys = "<br>".join(s["shuffle_keys"]) or "—"
        pushed = "<br>".join(s["pushed"]) or "—"
        read = "<br>".join(x.removeprefix("struct<").removesuffix(">") for x in s["read"])
        print(f"| `{key}` | {s['exchanges']}: {keys} | {s['broadcast'] or ''} | {s['windows'] or ''} | "
              f"{'yes' if s['expand'] else ''} | {pushed} | {read} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
