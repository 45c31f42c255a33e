"""The whole analysis as one Spark application.

1. Ingest: the action log (text, 5 or 7 columns) is parsed once and written
   as parquet under the shared checkpoint folder (or ``--stage-dir``),
   partitioned by ``accepted`` and ``date``.  Rejected lines keep their text
   and reason in the same write, so the input is scanned once.  The written table is the lineage cut: if
   executors are lost later, metrics recompute from it, not from the text.
   A parquet ``events`` table can be used directly instead (no ingest).
2. Hourly counts: one aggregate turns the log into one row per (date, hour,
   user, behaviour) with the number of actions, written the same way.
3. Metrics: every operator that needs no item column reads the hourly
   counts (day-level metrics touch one ``date=`` directory), the others the
   cleaned log; each writes under ``<out>/<metric>``; results reduced to key
   cardinality are written as one file, the others as several, both in the
   order of their key columns.
4. The tables that the job itself staged are deleted when it ends well.

Usage::

    spark-submit shopflow/plans/report.py --input hdfs:///logs/user_action.csv \\
        --layout 7 --out hdfs:///reports/run1 --day 2014-12-12

A log that arrives in pieces goes to a store (:mod:`shopflow.plans.store`)
piece by piece; the report then reads the store, not the log::

    ... --store hdfs:///stores/actions --input hdfs:///logs/monday.csv --batch monday --out hdfs:///reports/run2
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from shopflow.functions.ordering import by_frequency, in_order  # noqa: E402
from shopflow.operators import funnel, outliers, profile, repurchase, traffic, value  # noqa: E402
from shopflow.sources import sinks  # noqa: E402
from shopflow.sources.events import read_events  # noqa: E402
from shopflow.plans.store import ActionStore  # noqa: E402
from shopflow.schema import NATIVE, pre_aggregate  # noqa: E402
from shopflow.session import ensure_checkpoint_dir  # noqa: E402
from shopflow.sources.text_log import REJECT_REASON, for_table, parse_all, read_lines, read_parsed_table  # noqa: E402

# (name, operator, needs the day parameter, reduced to key cardinality,
#  needs item columns -- runs on the full log instead of the hourly counts)
METRICS = [
    ("dataset_profile", profile.dataset_profile, False, True, True),
    ("missing_profile", profile.missing_profile, False, True, True),
    ("pv_uv_by_date", traffic.pv_uv_by_date, False, True, False),
    ("pv_uv_by_hour", traffic.pv_uv_by_hour, False, True, False),
    ("pv_uv_by_hour_on_day", traffic.pv_uv_by_hour_on_day, True, True, False),
    ("pv_by_behavior_hour", traffic.pv_by_behavior_hour, False, True, False),
    ("pv_behavior_pivot", traffic.pv_behavior_pivot, False, True, False),
    ("hourly_day_vs_overall", traffic.hourly_day_vs_overall, True, True, False),
    ("behavior_counts", traffic.behavior_counts, False, True, False),
    ("behavior_counts_on_day", traffic.behavior_counts, True, True, False),
    ("funnel_rates", funnel.funnel_rates, False, True, False),
    ("funnel_rates_on_day", funnel.funnel_rates, True, True, False),
    ("funnel_step_loss", funnel.funnel_step_loss, False, True, False),
    ("ordered_funnel", funnel.ordered_funnel, False, True, False),
    ("ordered_funnel_times", funnel.ordered_funnel_times, False, False, False),
    ("activity_cuts", outliers.activity_cuts, False, True, False),
    ("actions_by_date_user_behavior", value.actions_by_date_user_behavior, False, False, False),
    ("daily_consumption", value.daily_consumption, False, True, False),
    ("buys_by_date_user", value.buys_by_date_user, False, False, False),
    ("buy_count_by_user", value.buy_count_by_user, False, False, False),
    ("buy_count_distribution", value.buy_count_distribution, False, True, False),
    ("arpu_by_date", value.arpu_by_date, False, True, False),
    ("arppu_by_date", value.arppu_by_date, False, True, False),
    ("paying_ratio_by_date", value.paying_ratio_by_date, False, True, False),
    ("pay_days_by_user", repurchase.pay_days_by_user, False, False, False),
    ("repeat_buy_rate", repurchase.repeat_buy_rate, False, True, False),
    ("buys_by_user_date", repurchase.buys_by_user_date, False, False, False),
    ("repurchase_gaps", repurchase.repurchase_gaps, False, False, False),
    ("repurchase_gap_lists", repurchase.repurchase_gap_lists, False, False, False),
    ("repurchase_gap_list_parts", repurchase.repurchase_gap_list_parts, False, False, False),
    ("repurchase_gap_runs", repurchase.repurchase_gap_runs, False, False, False),
    ("repurchase_item_intervals", repurchase.repurchase_item_intervals, False, False, True),
    ("repurchase_mean_by_user", repurchase.repurchase_mean_by_user, False, False, True),
    ("repurchase_gap_histogram", repurchase.repurchase_gap_histogram, False, True, False),
    ("repurchase_gap_cumulative", repurchase.repurchase_gap_cumulative, False, True, False),
]

# Written only when asked for by name: the lists written out, which ``repurchase_gap_runs`` has in little space.
ON_REQUEST = {"repurchase_gap_lists", "repurchase_gap_list_parts"}

# Key columns by which a result is written in order (others: their first column).
SORT_KEYS = {
    "pv_by_behavior_hour": ["behavior_type", "hour"],
    "funnel_step_loss": ["step"],
    "ordered_funnel": ["step"],
    "buy_count_distribution": ["bucket_lo"],
    "actions_by_date_user_behavior": ["date", "user_id", "behavior_type"],
    "buys_by_date_user": ["date", "user_id"],
    "buys_by_user_date": ["user_id", "date"],
    "repurchase_gaps": ["user_id", "date"],
    "repurchase_gap_list_parts": ["user_id", "part"],
    "repurchase_gap_runs": ["user_id", "date"],
    "repurchase_item_intervals": ["user_id", "item_id", "date"],
}

HOURLY_SCHEMA = "hour int, user_id bigint, behavior_type int, n_actions bigint, date date"


def _adaptive(spark: SparkSession) -> bool:
    # Without adaptive execution a rebalance is a plain hash repartition, which
    # would put a whole hot day in one task; then the write goes without it.
    return spark.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true"


def ingest_text(
    spark: SparkSession,
    path: str,
    stage_dir: str | None = None,
    layout: int = 7,
    rebalance: bool = False,
    spread: int | None = None,
    **kw,
) -> tuple[DataFrame, DataFrame]:
    """Parse the log once, write it, return (actions, rejects) read back.

    The table goes to ``stage_dir``, by default a new folder under the
    session's shared checkpoint folder (``spark.checkpoint.dir``).

    By default there is no shuffle before the write: a time-ordered log gives
    each input split only a few days, so each task writes few ``date=``
    files.  For a log in another order, ``rebalance=True`` adds one shuffle
    on (accepted, date) through the ``rebalance`` hint, whose adaptive
    execution splits a hot day over several tasks and merges small ones.
    """
    parsed = for_table(parse_all(read_lines(spark, path, spread), layout=layout, **kw))
    if rebalance and _adaptive(spark):
        parsed = parsed.hint("rebalance", "accepted", "date")
    if stage_dir is None:
        stage_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/actions-{uuid.uuid4().hex}"
    parsed.write.mode("overwrite").partitionBy("accepted", "date").parquet(stage_dir)
    return read_parsed_table(spark, stage_dir)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this job staged, through the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


SINKS = {
    "json": sinks.write_json,  # K-1 JSON lines
    "text": sinks.write_report,  # K-2 "field: value, ..." lines
    "tsv": sinks.write_tsv,  # K-3 tab-separated
}


def hourly_counts(spark: SparkSession, actions: DataFrame, stage_dir: str | None = None) -> DataFrame:
    """Pre-aggregate the log once to one row per (date, hour, user, behaviour)
    with ``n_actions``, write it (partitioned by date) under the shared
    checkpoint folder and read it back.  Most metrics then scan this table
    instead of the log; it is also their lineage cut.

    The aggregate comes out hash-partitioned on all four keys, so every task
    would hold every day; the ``rebalance`` hint on ``date`` regroups the
    (already reduced) rows so each day is written by a few tasks of the
    advisory size, a hot day split over several, instead of one small file
    per task and day."""
    if stage_dir is None:
        stage_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourly-{uuid.uuid4().hex}"
    hourly = pre_aggregate(actions.drop(NATIVE))  # the written table has the codes to filter by
    if _adaptive(spark):
        hourly = hourly.hint("rebalance", "date")
    hourly.write.mode("overwrite").partitionBy("date").parquet(stage_dir)
    return spark.read.schema(HOURLY_SCHEMA).parquet(stage_dir)


def run(
    spark: SparkSession,
    actions: DataFrame | None,
    out: str,
    day=None,
    rejects: DataFrame | None = None,
    sink: str = "json",
    preaggregate: bool = True,
    parallel: int = 4,
    only=None,
    gaps_by_frequency: bool = False,
    ordered: bool = True,
    store: ActionStore | None = None,
) -> list[str]:
    """Write every metric under ``out``; returns the names written.

    T-1: results are sorted by key.  Those reduced to key cardinality are one
    file; the others are range-partitioned by their keys and sorted within,
    so that the files, in the order of their names, are one sorted list
    (``ordered=False`` writes them as they come, a shuffle less).  ``gaps_by_frequency`` puts the gap
    histogram in the order of its counts instead, largest first.
    ``repurchase_gap_lists`` and ``repurchase_gap_list_parts`` are written
    only if ``only`` names them; ``repurchase_gap_runs`` has the same content
    in rows of bounded size.

    With a ``store`` the metrics come from its tables, and ``actions`` is not
    needed.

    With ``preaggregate`` (default) the metrics that need no item columns
    run on :func:`hourly_counts`; the operators count ``n_actions``, so the
    results are the same as on the log itself.
    """
    write = SINKS[sink]
    chosen = [m for m in METRICS if (m[0] not in ON_REQUEST if only is None else m[0] in set(only))]
    unknown = set(only or ()) - {m[0] for m in METRICS} - {"rejected_lines"}
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    staged = None
    own = {}
    if store is not None:
        actions, counts = store.purchases(), store.hourly()
        own = {
            "dataset_profile": store.dataset_profile,
            "missing_profile": store.missing_profile,
            "repurchase_gap_histogram": store.gap_histogram,
            "repurchase_gap_cumulative": store.gap_cumulative,
        }
    elif preaggregate and any(not m[4] for m in chosen):
        staged = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourly-{uuid.uuid4().hex}"
        counts = hourly_counts(spark, actions, staged)
    else:
        counts = actions
    jobs = []
    for name, op, needs_day, reduced, raw_only in chosen:
        if needs_day and day is None:
            continue
        src = actions if raw_only else counts
        df = own[name]() if name in own else op(src, day) if needs_day else op(src)
        jobs.append((name, df, reduced))
    if rejects is not None and (only is None or "rejected_lines" in only):
        by_reason = rejects.groupBy(REJECT_REASON).agg(F.count(F.lit(1)).alias("n"))
        jobs.append(("rejected_lines", by_reason, True))

    def save(job):
        name, df, reduced = job
        if reduced or ordered:
            by_count = gaps_by_frequency and name == "repurchase_gap_histogram"
            df = by_frequency(df, "n") if by_count else in_order(df, *SORT_KEYS.get(name, df.columns[:1]))
        write(df, f"{out.rstrip('/')}/{name}", single_file=reduced)
        return name

    # Independent small jobs: a few driver threads let Spark's scheduler run
    # them side by side instead of leaving the cluster idle between them.
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        names = list(pool.map(save, jobs))
    if staged:
        delete_folder(spark, staged)
    return names


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description="user-behaviour report over an action log")
    ap.add_argument("--input", default=None, help="text log path, or an events parquet path")
    ap.add_argument("--format", choices=["text", "events"], default="text")
    ap.add_argument("--layout", type=int, choices=[5, 7], default=7)
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--day", default=None, help="day D for the day-level metrics (yyyy-MM-dd)")
    ap.add_argument("--sink", choices=sorted(SINKS), default="json")
    ap.add_argument("--rebalance", action="store_true", help="shuffle by day before writing (unordered logs)")
    ap.add_argument("--stage-dir", default=None, help="where the parsed log is written (default: checkpoint dir)")
    ap.add_argument("--no-preaggregate", action="store_true", help="run every metric on the full log")
    ap.add_argument("--spread", type=int, default=None, help="deal lines to N partitions (unsplittable input)")
    ap.add_argument("--parallel", type=int, default=4, help="metric jobs submitted at once")
    ap.add_argument("--only", default=None, help="comma-separated metric names (default: all but repurchase_gap_lists)")
    ap.add_argument("--gaps-by-frequency", action="store_true", help="gap histogram by count, largest first")
    ap.add_argument("--unsorted", action="store_true", help="per-user results as they come, not in key order")
    ap.add_argument("--store", default=None, help="shared folder of the batch store: report from it")
    ap.add_argument("--batch", default=None, help="with --store: add the input to it under this name first")
    args = ap.parse_args(argv)
    if args.store is None and (args.input is None or args.batch is not None):
        ap.error("--input is required without --store, and --batch needs --store")
    if (args.input is None) != (args.batch is None) and args.store is not None:
        ap.error("with --store, --input and --batch come together")

    from shopflow.session import build_session

    spark = build_session(app="shopflow-report")  # reads spark.checkpoint.dir from the cluster
    own_stage = store = actions = rejects = None
    if args.input is None:
        pass
    elif args.format == "text":
        if args.stage_dir is None:
            own_stage = f"{ensure_checkpoint_dir(spark).rstrip('/')}/actions-{uuid.uuid4().hex}"
        actions, rejects = ingest_text(
            spark, args.input, args.stage_dir or own_stage, layout=args.layout, rebalance=args.rebalance, spread=args.spread
        )
    else:
        actions, rejects = read_events(spark, args.input), None
    if args.store is not None:
        store = ActionStore(spark, args.store)
        if args.batch is not None:
            store.apply(args.batch, actions, rejects)
        rejects = store.table("rejects")
    written = run(
        spark, actions, args.out, args.day, rejects,
        sink=args.sink, preaggregate=not args.no_preaggregate, parallel=args.parallel,
        only=args.only.split(",") if args.only else None, gaps_by_frequency=args.gaps_by_frequency,
        ordered=not args.unsorted, store=store,
    )
    if own_stage:
        delete_folder(spark, own_stage)
    for name in written:
        print(f"wrote {args.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
