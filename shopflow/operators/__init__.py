"""All metric operators: ``(actions: DataFrame, *params) -> DataFrame``."""

from shopflow.operators.funnel import funnel_counts, funnel_rates, funnel_step_loss, ordered_funnel, ordered_funnel_times
from shopflow.operators.outliers import activity, activity_cuts, outlier_groups, without_outliers
from shopflow.operators.profile import dataset_profile, file_quality, log_profile, missing_profile
from shopflow.operators.repurchase import (
    buys_by_user_date,
    pay_days_by_user,
    repeat_buy_rate,
    repurchase_gap_cumulative,
    repurchase_gap_histogram,
    repurchase_gap_list_parts,
    repurchase_gap_lists,
    repurchase_gap_runs,
    repurchase_gaps,
    repurchase_item_intervals,
    repurchase_mean_by_user,
)
from shopflow.operators.traffic import (
    behavior_counts,
    hourly_day_vs_overall,
    pv_behavior_pivot,
    pv_by_behavior_hour,
    pv_by_date,
    pv_by_hour,
    pv_uv_by_date,
    pv_uv_by_hour,
    pv_uv_by_hour_on_day,
    pv_uv_join_on_day,
    uv_by_date,
    uv_by_hour,
)
from shopflow.operators.value import (
    actions_by_date_user_behavior,
    arppu_by_date,
    arpu_by_date,
    buy_count_by_user,
    buy_count_distribution,
    buys_by_date_user,
    daily_consumption,
    paying_ratio_by_date,
    purchases,
    user_item_purchases,
    user_purchases,
)
from shopflow.operators.visitors import count_visitors, number_users, uv_between, uv_by_period, uv_rolling, visitor_bitmaps

__all__ = [n for n in dir() if not n.startswith("_") and n not in {"funnel", "outliers", "profile", "repurchase", "traffic", "value", "visitors"}]
