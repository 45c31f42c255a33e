"""Traffic metrics: page views (PV) and unique visitors (UV).

PV counts every action (``count(*)``); UV counts distinct non-NULL
``user_id``.  UV by hour is distinct users over all days for that clock hour.

Plan shape: PV is a partial/final hash aggregate, so each map task sends at
most one row per key.  UV is Spark's two-level distinct aggregate: the first
shuffle is on (key, user_id) after a map-side dedupe, so a user holding a
third of all rows still sends one row per key per map task; the second
shuffle carries partial counts per key only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.schema import BUY, BROWSE, CART, FAVOURITE, count_actions, count_actions_if, on_day


def _pv(actions: DataFrame):
    return count_actions(actions).alias("pv")


def _uv():
    return F.count_distinct("user_id").alias("uv")


def pv_by(actions: DataFrame, *keys: str) -> DataFrame:
    return actions.groupBy(*keys).agg(_pv(actions))


def uv_by(actions: DataFrame, *keys: str) -> DataFrame:
    return actions.groupBy(*keys).agg(_uv())


def pv_uv_by(actions: DataFrame, *keys: str) -> DataFrame:
    """O-6: PV and UV per key from one scan and one aggregate."""
    return actions.groupBy(*keys).agg(_pv(actions), _uv())


def pv_by_date(actions: DataFrame) -> DataFrame:
    """O-2."""
    return pv_by(actions, "date")


def uv_by_date(actions: DataFrame) -> DataFrame:
    """O-3."""
    return uv_by(actions, "date")


def pv_by_hour(actions: DataFrame) -> DataFrame:
    """O-4."""
    return pv_by(actions, "hour")


def uv_by_hour(actions: DataFrame) -> DataFrame:
    """O-5."""
    return uv_by(actions, "hour")


def pv_uv_by_date(actions: DataFrame) -> DataFrame:
    """O-6 by day."""
    return pv_uv_by(actions, "date")


def pv_uv_by_hour(actions: DataFrame) -> DataFrame:
    """O-6 by hour."""
    return pv_uv_by(actions, "hour")


def pv_uv_by_hour_on_day(actions: DataFrame, day) -> DataFrame:
    """O-7: PV and UV by hour on one day; the day filter reaches the scan."""
    return pv_uv_by(on_day(actions, day), "hour")


def pv_uv_join_on_day(actions: DataFrame, day) -> DataFrame:
    """J-1: O-7 computed as two hourly tables joined on ``hour``.

    Both sides are keyed by hour of day, so each has at most 24 rows; Spark's
    own size check broadcasts one of them.
    """
    day_rows = on_day(actions, day)
    pv = pv_by(day_rows, "hour")
    uv = uv_by(day_rows, "hour")
    return pv.join(uv, "hour", "inner").select("hour", "pv", "uv")


def pv_by_behavior_hour(actions: DataFrame) -> DataFrame:
    """O-8: PV per (behaviour, hour)."""
    return pv_by(actions, "behavior_type", "hour")


def behavior_counts(actions: DataFrame, day=None) -> DataFrame:
    """O-9 (all days) / O-10 (``day`` given): actions per behaviour."""
    rows = actions if day is None else on_day(actions, day)
    return rows.groupBy("behavior_type").agg(count_actions(rows).alias("n"))


def pv_behavior_pivot(actions: DataFrame) -> DataFrame:
    """R-1: one column of PV per behaviour (b1..b4), one row per hour.

    Written as conditional counts rather than ``pivot``: one aggregate and
    one shuffle of at most 24 keys per map task.  Hours whose only actions
    have another code still appear, with zeros.
    """
    code = F.col("behavior_type")
    return actions.groupBy("hour").agg(
        *[
            count_actions_if(actions, code == F.lit(c)).alias(f"b{c}")
            for c in (BROWSE, FAVOURITE, CART, BUY)
        ]
    )


def hourly_day_vs_overall(actions: DataFrame, day) -> DataFrame:
    """R-2: PV/UV by hour over all days next to the same for ``day``.

    The day side reads one day (pushed range) and has at most 24 rows, which
    Spark broadcasts by its size; this avoids the row-doubling Expand that two
    conditional distinct counts in one aggregate would cost over the whole log.
    """
    overall = pv_uv_by_hour(actions)
    on = pv_uv_by_hour_on_day(actions, day).select(
        "hour", F.col("pv").alias("pv_day"), F.col("uv").alias("uv_day")
    )
    joined = overall.join(on, "hour", "left")
    return joined.select(
        "hour",
        "pv",
        "uv",
        F.coalesce("pv_day", F.lit(0).cast("bigint")).alias("pv_day"),
        F.coalesce("uv_day", F.lit(0).cast("bigint")).alias("uv_day"),
    )
