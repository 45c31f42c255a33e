"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver's
tables -- ``events`` through the ACTIONS adapter, or ``orders`` and
``lineitem`` for the ``order_*`` keys -- read whole, so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopflow.functions.ordering import by_frequency
from shopflow.operators import funnel, outliers, profile, repurchase, traffic, value, visitors
from shopflow.plans import sql_forms
from shopflow.plans.batches import files_by_day, stored
from shopflow.plans.messy_log import messy_lines, with_unknowns
from shopflow.plans.store import ActionStore
from shopflow.schema import pre_aggregate
from shopflow.sources import sinks
from shopflow.sources.events import read_events, table_path
from shopflow.sources.orders import read_order_purchases
from shopflow.sources.text_log import parse_lines, rejected_counts, render_lines

# Fixed value: the "peak day" parameter D used by the day-level queries.
DAY = "2024-01-12"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, table_path(sf_dir, "events"))


def _on(fn, *args):
    return lambda spark, sf_dir: fn(actions(spark, sf_dir), *args)


def _on_orders(fn, *args, items=False):
    # Metrics without items read one row per order (line items counted first).
    return lambda spark, sf_dir: fn(read_order_purchases(spark, sf_dir, items=items), *args)


def _on_hourly(fn, *args):
    # The same operator on the (date, hour, user, behaviour) pre-aggregate.
    return lambda spark, sf_dir: fn(pre_aggregate(actions(spark, sf_dir)), *args)


def _parsed(spark: SparkSession, sf_dir: str):
    # The events rendered as a 7-column log; the "other" code 0 is outside the
    # log's valid codes 1-4, so those lines are the rejects.
    return parse_lines(render_lines(actions(spark, sf_dir), layout=7), layout=7)


def _with_unknowns(fn, *args):
    # The same operator on actions some of whose users and items are unknown.
    return lambda spark, sf_dir: fn(with_unknowns(actions(spark, sf_dir)), *args)


def _messy(spark: SparkSession, sf_dir: str, layout: int = 7):
    return parse_lines(messy_lines(actions(spark, sf_dir), layout), layout=layout)


def _on_visitors(fn, *args, keys=("date",)):
    # Distinct users of many days from the bitmaps of each.
    return lambda spark, sf_dir: fn(visitors.visitor_bitmaps(actions(spark, sf_dir), *keys), *args)


_STORES: dict[tuple[str, str], ActionStore] = {}


def _from_store(metric):
    # The same metric from a store that has taken the log in three batches, late lines included.
    # The store is filled once per session and folder; every metric reads it.
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _STORES:
            _STORES[key] = stored(spark, actions(spark, sf_dir), DAY)
        return metric(_STORES[key])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dataset_profile": _on(profile.dataset_profile),
    "missing_profile": _on(profile.missing_profile),
    "pv_by_date": _on(traffic.pv_by_date),
    "uv_by_date": _on(traffic.uv_by_date),
    "pv_by_hour": _on(traffic.pv_by_hour),
    "uv_by_hour": _on(traffic.uv_by_hour),
    "pv_uv_by_date": _on(traffic.pv_uv_by_date),
    "pv_uv_by_hour": _on(traffic.pv_uv_by_hour),
    "pv_uv_by_hour_on_day": _on(traffic.pv_uv_by_hour_on_day, DAY),
    "pv_uv_join_on_day": _on(traffic.pv_uv_join_on_day, DAY),
    "pv_by_behavior_hour": _on(traffic.pv_by_behavior_hour),
    "behavior_counts": _on(traffic.behavior_counts),
    "behavior_counts_on_day": _on(traffic.behavior_counts, DAY),
    "funnel_rates": _on(funnel.funnel_rates),
    "funnel_rates_on_day": _on(funnel.funnel_rates, DAY),
    "funnel_step_loss": _on(funnel.funnel_step_loss),
    "ordered_funnel": _on(funnel.ordered_funnel),
    "ordered_funnel_on_day": _on(funnel.ordered_funnel, DAY),
    "ordered_funnel_times": _on(funnel.ordered_funnel_times),
    "ordered_funnel_hourly": _on_hourly(funnel.ordered_funnel),
    "buy_count_by_user": _on(value.buy_count_by_user),
    "actions_by_date_user_behavior": _on(value.actions_by_date_user_behavior),
    "daily_consumption": _on(value.daily_consumption),
    "arpu_by_date": _on(value.arpu_by_date),
    "buys_by_date_user": _on(value.buys_by_date_user),
    "arppu_by_date": _on(value.arppu_by_date),
    "paying_ratio_by_date": _on(value.paying_ratio_by_date),
    "buy_count_distribution": _on(value.buy_count_distribution),
    "pay_days_by_user": _on(repurchase.pay_days_by_user),
    "repeat_buy_rate": _on(repurchase.repeat_buy_rate),
    "buys_by_user_date": _on(repurchase.buys_by_user_date),
    "repurchase_gaps": _on(repurchase.repurchase_gaps),
    "repurchase_gap_lists": _on(repurchase.repurchase_gap_lists),
    "repurchase_gap_runs": _on(repurchase.repurchase_gap_runs),
    "repurchase_gap_list_parts": _on(repurchase.repurchase_gap_list_parts),
    "repurchase_gap_list_parts_small": _on(repurchase.repurchase_gap_list_parts, 3),
    "repurchase_item_intervals": _on(repurchase.repurchase_item_intervals),
    "repurchase_mean_by_user": _on(repurchase.repurchase_mean_by_user),
    "repurchase_gap_histogram": _on(repurchase.repurchase_gap_histogram),
    "repurchase_gap_cumulative": _on(repurchase.repurchase_gap_cumulative),
    "pv_behavior_pivot": _on(traffic.pv_behavior_pivot),
    "hourly_day_vs_overall": _on(traffic.hourly_day_vs_overall, DAY),
    # Visitors of any days, from bitmaps per day.
    "uv_rolling_7_days": _on_visitors(visitors.uv_rolling, 7),
    "uv_by_week": _on_visitors(visitors.uv_by_period, "week"),
    "uv_by_month": _on_visitors(visitors.uv_by_period, "month"),
    "uv_by_hour_bitmaps": _on_visitors(visitors.count_visitors, "hour", keys=("date", "hour")),
    # P-6: groups of actions that are far too many.
    "activity_cuts": _on(outliers.activity_cuts),
    "activity_cuts_daily": _on(outliers.activity_cuts, ("user_id", "date")),
    "outlier_user_days": _on(outliers.outlier_groups, "q99", ("user_id", "date")),
    "pv_uv_by_date_without_outliers": lambda spark, d: traffic.pv_uv_by_date(outliers.without_outliers(actions(spark, d), "q99", ("user_id", "date"))),
    # S-3, P-5 per input file.
    "file_quality": lambda spark, d: profile.file_quality(files_by_day(spark, actions(spark, d))),
    # S-5, S-6: the log taken batch by batch.
    "store_pv_uv_by_date": _from_store(lambda s: traffic.pv_uv_by_date(s.hourly())),
    "store_arpu_by_date": _from_store(lambda s: value.arpu_by_date(s.hourly())),
    "store_dataset_profile": _from_store(lambda s: s.dataset_profile()),
    "store_missing_profile": _from_store(lambda s: s.missing_profile()),
    "store_repurchase_mean_by_user": _from_store(lambda s: repurchase.repurchase_mean_by_user(s.purchases())),
    "store_uv_rolling_7_days": _from_store(lambda s: visitors.uv_rolling(s.visitors(), 7)),
    # O-30, O-33, O-34 over batches: from each batch's change of the histogram.
    "store_repurchase_gap_histogram": _from_store(lambda s: s.gap_histogram()),
    "store_repurchase_gap_cumulative": _from_store(lambda s: s.gap_cumulative()),
    "store_last_purchase_days": _from_store(lambda s: s.last_purchase_days()),
    "parse_action_lines": lambda spark, d: _parsed(spark, d)[0],
    "rejected_lines": lambda spark, d: rejected_counts(_parsed(spark, d)[1]),
    # A log with header lines, cut fields, blank fields and ids that are no numbers, in both layouts.
    "log_profile": lambda spark, d: profile.log_profile(messy_lines(actions(spark, d))),
    "parse_messy_lines": lambda spark, d: _messy(spark, d)[0],
    "parse_messy_lines_5": lambda spark, d: _messy(spark, d, 5)[0],
    "rejected_messy_lines": lambda spark, d: rejected_counts(_messy(spark, d)[1]),
    "rejected_messy_lines_5": lambda spark, d: rejected_counts(_messy(spark, d, 5)[1]),
    "buy_count_distribution_small": _on(value.buy_count_distribution, (5, 10, 20)),
    "repurchase_gap_frequency": lambda spark, d: by_frequency(repurchase.repurchase_gap_histogram(actions(spark, d)), "n"),
    "text_report": lambda spark, d: sinks.report_lines(traffic.pv_uv_by_date(actions(spark, d))),
    # C-1: the same metrics written as SQL CTEs and run through spark.sql.
    "arpu_by_date_sql": _on(sql_forms.arpu_by_date_sql),
    "paying_ratio_by_date_sql": _on(sql_forms.paying_ratio_by_date_sql),
    "repurchase_mean_by_user_sql": _on(sql_forms.repurchase_mean_by_user_sql),
    # Over a named view (S-4), sorted (T-2).
    "pv_uv_by_date_view": _on(sql_forms.pv_uv_by_date_view),
    # Unknown users and items: left out of per-user and per-item metrics.
    "unknowns_pv_uv_by_date": _with_unknowns(traffic.pv_uv_by_date),
    "unknowns_arppu_by_date": _with_unknowns(value.arppu_by_date),
    "unknowns_buy_count_distribution": _with_unknowns(value.buy_count_distribution, (5, 10, 20)),
    "unknowns_repeat_buy_rate": _with_unknowns(repurchase.repeat_buy_rate),
    "unknowns_repurchase_gaps": _with_unknowns(repurchase.repurchase_gaps),
    "unknowns_ordered_funnel": _with_unknowns(funnel.ordered_funnel),
    "unknowns_repurchase_gap_lists": _with_unknowns(repurchase.repurchase_gap_lists),
    "unknowns_repurchase_gap_cumulative": _with_unknowns(repurchase.repurchase_gap_cumulative),
    "unknowns_repurchase_item_intervals": _with_unknowns(repurchase.repurchase_item_intervals),
    "unknowns_repurchase_mean_by_user": _with_unknowns(repurchase.repurchase_mean_by_user),
    # The report job's plan: operators on the hourly pre-aggregate (n_actions).
    "pv_uv_by_date_hourly": _on_hourly(traffic.pv_uv_by_date),
    "arpu_by_date_hourly": _on_hourly(value.arpu_by_date),
    "repurchase_gap_lists_hourly": _on_hourly(repurchase.repurchase_gap_lists),
    # Purchase-side operators over orders JOIN lineitem (one action per line item).
    "order_arppu_by_date": _on_orders(value.arppu_by_date),
    "order_pay_days_by_user": _on_orders(repurchase.pay_days_by_user),
    "order_repeat_buy_rate": _on_orders(repurchase.repeat_buy_rate),
    "order_repurchase_gaps": _on_orders(repurchase.repurchase_gaps),
    "order_repurchase_gap_lists": _on_orders(repurchase.repurchase_gap_lists),
    "order_repurchase_gap_list_parts": _on_orders(repurchase.repurchase_gap_list_parts, 10),
    "order_repurchase_mean_by_user": _on_orders(repurchase.repurchase_mean_by_user, items=True),
    "order_repurchase_gap_cumulative": _on_orders(repurchase.repurchase_gap_cumulative),
}
