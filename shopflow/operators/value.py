"""User value: purchases per user, ARPU, ARPPU, paying ratio.

The dataset has no money column, so "revenue" is the number of purchases.
All per-day ratios are single aggregation chains: no join of two aggregated
tables is needed (join elimination by conditional aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.columns import bucket_label, bucket_low, ratio, ratio_or_zero
from shopflow.schema import BUY, behavior_is, count_actions, count_actions_if

# Purchase-count bucket edges from the published analysis
# (most users under 50 purchases, some over 100, a few over 800).
DEFAULT_BUY_BOUNDS = (50, 100, 800)


def purchases(actions: DataFrame) -> DataFrame:
    """F-2: purchase actions only (pushed to the scan for parquet sources)."""
    return actions.where(behavior_is(actions, BUY))


def user_purchases(actions: DataFrame) -> DataFrame:
    """Purchases with a known user.

    An anonymous purchase counts in PV and in the purchase totals, but it
    belongs to nobody: per-user metrics leave it out, as UV does.
    """
    return purchases(actions).where(F.col("user_id").isNotNull())


def user_item_purchases(actions: DataFrame) -> DataFrame:
    """Purchases with a known user and a known item: unknown items are not the same item."""
    return user_purchases(actions).where(F.col("item_id").isNotNull())


def buy_count_by_user(actions: DataFrame) -> DataFrame:
    """O-14: purchases per (known) user."""
    buys = user_purchases(actions)
    return buys.groupBy("user_id").agg(count_actions(buys).alias("buy_count"))


def actions_by_date_user_behavior(actions: DataFrame) -> DataFrame:
    """O-15: actions per (date, user, behaviour)."""
    return actions.groupBy("date", "user_id", "behavior_type").agg(count_actions(actions).alias("n"))


def daily_consumption(actions: DataFrame) -> DataFrame:
    """O-16: purchases and active (distinct) users per day."""
    return actions.groupBy("date").agg(
        count_actions_if(actions, F.col("behavior_type") == F.lit(BUY)).alias("buys"),
        F.count_distinct("user_id").alias("active_users"),
    )


def arpu_by_date(actions: DataFrame) -> DataFrame:
    """O-17: purchases per active user per day.

    Days without purchases are kept with 0.0; one aggregate, no join.
    """
    d = daily_consumption(actions)
    return d.select("date", ratio_or_zero("buys", "active_users").alias("arpu"))


def buys_by_date_user(actions: DataFrame) -> DataFrame:
    """O-18: purchases per (date, user); anonymous purchases are a row with a NULL user."""
    buys = purchases(actions)
    return buys.groupBy("date", "user_id").agg(count_actions(buys).alias("buy_count"))


def arppu_by_date(actions: DataFrame) -> DataFrame:
    """O-19: purchases per paying user per day; days without (known) payers are absent.

    ``count(*) / count(distinct user_id)`` over purchases: Spark pre-aggregates
    per (date, user) inside the distinct aggregate, which is the two-step plan
    of the original, without a join.
    """
    buys = purchases(actions)
    d = buys.groupBy("date").agg(count_actions(buys).alias("buys"), F.count_distinct("user_id").alias("payers"))
    return d.where(F.col("payers") > 0).select("date", ratio("buys", "payers").alias("arppu"))


def paying_ratio_by_date(actions: DataFrame) -> DataFrame:
    """O-20: distinct paying users / distinct active users per day.

    Two-step aggregate instead of two distinct counts (which would Expand
    every row twice): first one row per (date, user) with "did buy", built
    map-side; then per day count the users and the payers.  A NULL user forms
    its own row but is counted in neither.
    """
    per_user = actions.groupBy("date", "user_id").agg(
        F.max((F.col("behavior_type") == F.lit(BUY)).cast("int")).alias("paid")
    )
    has_user = F.col("user_id").isNotNull()
    d = per_user.groupBy("date").agg(
        F.count_if(has_user & (F.col("paid") == 1)).alias("paying_users"),
        F.count_if(has_user).alias("active_users"),
    )
    return d.select(
        "date",
        "paying_users",
        "active_users",
        ratio_or_zero("paying_users", "active_users").alias("paying_ratio"),
    )


def buy_count_distribution(actions: DataFrame, bounds=DEFAULT_BUY_BOUNDS) -> DataFrame:
    """O-21: how many users fall in each purchase-count interval."""
    per_user = buy_count_by_user(actions)
    return per_user.groupBy(
        bucket_low("buy_count", bounds).alias("bucket_lo"),
        bucket_label("buy_count", bounds).alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("users"))
