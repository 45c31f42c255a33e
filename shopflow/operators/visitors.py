"""Unique visitors of any set of days (O-3, O-5, O-6 across days).

Distinct counts of days don't add up to the distinct count of a week, but
bitmaps do: a table holds, per key (day, or day and hour) and bucket of
32,768 user numbers, which users were active.  It is computed once; the
visitors of any days are then the bits set in the union of their bitmaps, for
a few kilobytes per bucket instead of a new pass over the log.  All counts
are exact.

Any id has a bit, negative ones too.  Ids that are scattered over a wide
range would have a bitmap each; :func:`number_users` gives users numbers that
lie together, which a table keeps from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.schema import WEIGHT, day_literal

#: Numbers of one task's users start at a multiple of this (as ``monotonically_increasing_id`` has it).
_TASK_NUMBERS = 1 << 33


def number_users(actions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``user_id, number`` for the users that ``known`` (the same columns) has not yet.

    Each task numbers its users one after another, from a start of its own
    beyond all known numbers, so that a bucket of a bitmap is filled by one
    task's users.  Write the result before using it: evaluated again, the
    numbers may differ.
    """
    users = actions.where(F.col("user_id").isNotNull()).select("user_id").distinct()
    if known is None:
        return users.withColumn("number", F.monotonically_increasing_id() + 1)
    highest = known.agg(F.max("number")).first()[0] or 0  # one number
    start = (highest // _TASK_NUMBERS + 1) * _TASK_NUMBERS
    return users.join(known, "user_id", "left_anti").withColumn("number", F.monotonically_increasing_id() + F.lit(start + 1).cast("bigint"))


def visitor_bitmaps(actions: DataFrame, *keys: str, numbers: DataFrame | None = None) -> DataFrame:
    """``keys, bucket, users``: the users of each key (default ``date``) as bitmaps, unknown users left out.

    Actions are reduced to one row per key and user first, with a map-side
    combine; only those are sorted into buckets.  ``numbers`` (``user_id,
    number``) replaces the ids by numbers that lie together; actions that are
    counts already are then not reduced once more, as the same bit set twice
    is one bit, and move once, to their users' numbers.
    """
    keys = keys or ("date",)
    rows = actions.where(F.col("user_id").isNotNull()).select(*keys, "user_id")
    if numbers is None or WEIGHT not in actions.columns:
        rows = rows.distinct()
    rows = rows.withColumn("number", F.col("user_id")) if numbers is None else rows.join(numbers, "user_id")
    bits = rows.select(*keys, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit"))
    return bits.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("users"))


def count_visitors(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """``keys, uv``: the distinct users of all bitmaps of each key (of all of them, without keys)."""
    whole = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    # An unset count of no bitmaps at all is 0.
    return whole.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("users")), F.lit(0).cast("bigint")).alias("uv"))


def uv_between(bitmaps: DataFrame, first, last) -> DataFrame:
    """One row ``uv``: the visitors of the days ``first`` to ``last``; only these days are read."""
    return count_visitors(bitmaps.where(F.col("date").between(day_literal(first), day_literal(last))))


def uv_by_period(bitmaps: DataFrame, period: str) -> DataFrame:
    """``start, uv`` per calendar period (``week``, ``month``, ``quarter``, ``year``)."""
    return count_visitors(bitmaps.withColumn("start", F.trunc("date", period)), "start")


def uv_rolling(bitmaps: DataFrame, days: int) -> DataFrame:
    """``date, uv``: for every day of the table, the visitors of the ``days`` days that end with it.

    Each bitmap goes to the days whose window it is in, and is united with
    the others map-side: what moves is bitmaps, not actions.
    """
    windows = F.sequence(F.col("date"), F.date_add("date", days - 1))
    sent = bitmaps.select("date", F.explode(windows).alias("end"), "bucket", "users")
    whole = sent.groupBy("end", "bucket").agg(F.bitmap_or_agg("users").alias("users"), F.max(F.col("date") == F.col("end")).alias("own"))
    # Days after the last one, or between, that have no bitmap of their own are no days of the table.
    counts = whole.groupBy("end").agg(F.sum(F.bitmap_count("users")).alias("uv"), F.max("own").alias("own"))
    return counts.where("own").select(F.col("end").alias("date"), "uv")
