"""Repurchase behaviour: purchase days, repeat rate and the gaps between buys.

Scale notes.  Every per-user (or per user and item) window runs over rows
already reduced to one per (user[, item], day): a user can hold a third of
all raw rows, but a window partition holds at most one row per calendar day
of the log.  The reductions are hash aggregates with map-side combine, keyed
on (user, day) so a hot user is spread over many reducers.  The only
unpartitioned window (O-34) runs over the gap histogram, at most one row per
distinct gap length.

Purchases without a user are left out of every per-user metric, and those without
an item of the per-item ones (W-1, O-32): unknown users or items are not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.columns import ratio
from shopflow.operators.value import purchases, user_item_purchases, user_purchases
from shopflow.schema import count_actions


# Bytes of one user's gap list: a string value is at most 2 GB in Spark.
LONGEST_LIST = 2_000_000_000
# Gaps in one part of a list that is cut into parts: at most a few MB of text.
PART = 500_000


def _by_user_date():
    return Window.partitionBy("user_id").orderBy("date")


def pay_days_by_user(actions: DataFrame) -> DataFrame:
    """O-22: number of distinct days on which each user bought."""
    return user_purchases(actions).groupBy("user_id").agg(F.count_distinct("date").alias("pay_days"))


def repeat_buy_rate(actions: DataFrame) -> DataFrame:
    """O-23: share of purchasers who bought on more than one day."""
    per_user = pay_days_by_user(actions)
    counts = per_user.agg(
        F.count(F.lit(1)).alias("purchasers"),
        F.count_if(F.col("pay_days") > 1).alias("repeat_purchasers"),
    )
    return counts.select(
        "purchasers", "repeat_purchasers", ratio("repeat_purchasers", "purchasers").alias("repeat_rate")
    )


def buys_by_user_date(actions: DataFrame) -> DataFrame:
    """O-24: purchases per (user, date); anonymous purchases are rows with a NULL user."""
    buys = purchases(actions)
    return buys.groupBy("user_id", "date").agg(count_actions(buys).alias("buy_count"))


def repurchase_gaps(actions: DataFrame) -> DataFrame:
    """O-30: days between consecutive purchase days, one row per gap.

    Gaps are >= 1 because same-day purchases collapse into one day first.
    ``date`` is the later day of each pair.
    """
    days = user_purchases(actions).select("user_id", "date").distinct()
    prev = F.lag("date").over(_by_user_date())
    gaps = days.select("user_id", "date", F.datediff("date", prev).alias("gap_days"))
    return gaps.where(F.col("gap_days").isNotNull())


def repurchase_gap_lists(actions: DataFrame) -> DataFrame:
    """O-31: per user, the gaps between all purchase actions in date order,
    comma-joined; ``''`` for a user with a single purchase.

    Same-day purchases give 0-day gaps, so a day with ``c`` purchases that
    follows a day ``g`` days earlier contributes ``g`` then ``c - 1`` zeros.
    The work therefore runs over one row per (user, day) carrying its count;
    only the output string grows with a user's purchases.  A string holds at
    most 2 GB, so a user whose days' pieces add up to more than
    ``LONGEST_LIST`` bytes fails with a message before any is built;
    :func:`repurchase_gap_list_parts` has no such limit.
    """
    buys = user_purchases(actions)
    per_day = buys.groupBy("user_id", "date").agg(count_actions(buys).alias("c"))
    per_day = per_day.select("user_id", "date", "c", F.datediff("date", F.lag("date").over(_by_user_date())).cast("string").alias("gap"))
    # Bytes of ",gap" (none on the first day) and ",0" per same-day repeat, over all days of the user.
    size = F.coalesce(F.length("gap") + 1, F.lit(0)) + 2 * (F.col("c") - 1)
    whole = F.sum(size).over(_by_user_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    too_many = F.raise_error(F.lit("a user's gap list exceeds a string; use repurchase_gap_list_parts"))
    repeats = F.when(F.col("size") <= LONGEST_LIST, F.col("c") - 1).otherwise(too_many.cast("bigint")).try_cast("int")
    # The leading comma is then dropped.
    text = F.concat(F.coalesce(F.concat(F.lit(","), F.col("gap")), F.lit("")), F.repeat(F.lit(",0"), repeats))
    piece = F.nullif(F.substring(text, 2, 2147483647), F.lit(""))
    pieces = per_day.withColumn("size", whole).select("user_id", "date", piece.alias("piece"))
    lists = pieces.groupBy("user_id").agg(
        F.expr("listagg(piece, ',') WITHIN GROUP (ORDER BY date)").alias("gaps")
    )
    return lists.select("user_id", F.coalesce("gaps", F.lit("")).alias("gaps"))


def repurchase_gap_list_parts(actions: DataFrame, part: int = PART) -> DataFrame:
    """O-31 for lists of any length: ``user_id, part, n, gaps``, numbered parts of at most ``part`` gaps each.

    A user's parts, joined by commas in the order of ``part`` (from 0), are
    the list of :func:`repurchase_gap_lists`; ``n`` is the number of gaps in a
    part.  A user with a single purchase has one empty part.

    A running count over a user's days gives the place of each day's gaps in
    the list, and with it the parts that the day takes part in: a day of
    billions of purchases is a row per part, each text of bounded length, and
    (user, part) groups are put together apart from each other.
    """
    if part < 1:
        raise ValueError("a part holds at least one gap")
    runs = repurchase_gap_runs(actions)
    placed = runs.withColumn("n", F.col("repeats") + F.col("gap_days").isNotNull().cast("bigint"))
    before = F.sum("n").over(_by_user_date().rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("start", F.coalesce(before, F.lit(0).cast("bigint"))).withColumn("end", F.col("start") + F.col("n"))
    # A user's first day may have no gap: its row still makes the first part.
    parts = F.expr(f"sequence(start div {part}, greatest(start, end - 1) div {part})")
    cut = placed.select("user_id", "date", "gap_days", "start", "end", F.explode(parts).alias("part"))
    cut = cut.select(
        "user_id", "date", "part",
        F.expr(f"least(end, (part + 1) * {part}) - greatest(start, part * {part})").alias("n"),
        F.when(F.col("start") >= F.col("part") * part, F.col("gap_days")).cast("string").alias("gap"),
    )
    # ",gap" where the day begins in this part, then a ",0" per further purchase; the leading comma goes.
    zeros = (F.col("n") - F.col("gap").isNotNull().cast("bigint")).cast("int")
    text = F.concat(F.coalesce(F.concat(F.lit(","), F.col("gap")), F.lit("")), F.repeat(F.lit(",0"), zeros))
    pieces = cut.select("user_id", "date", "part", "n", F.nullif(F.substring(text, 2, 2147483647), F.lit("")).alias("piece"))
    lists = pieces.groupBy("user_id", "part").agg(F.sum("n").alias("n"), F.expr("listagg(piece, ',') WITHIN GROUP (ORDER BY date)").alias("gaps"))
    return lists.select("user_id", "part", "n", F.coalesce("gaps", F.lit("")).alias("gaps"))


def repurchase_gap_runs(actions: DataFrame) -> DataFrame:
    """O-31 as rows: one row per (user, purchase day) with the gap from the
    previous purchase day (NULL on the first) and ``repeats``, the number of
    further purchases that day (each a 0-day gap).

    Lossless: the O-31 list of a user is, day by day, ``gap_days`` then
    ``repeats`` zeros.  Every row is bounded, so this form suits users whose
    list would be too long for one string value.
    """
    buys = user_purchases(actions)
    per_day = buys.groupBy("user_id", "date").agg(count_actions(buys).alias("c"))
    return per_day.select(
        "user_id",
        "date",
        F.datediff("date", F.lag("date").over(_by_user_date())).alias("gap_days"),
        (F.col("c") - 1).alias("repeats"),
    )


def repurchase_item_intervals(actions: DataFrame) -> DataFrame:
    """W-1: per (user, item, purchase day) the next day the same user bought
    the same item (``lead``), the days until then, and ``repeats``, the
    further purchases of that item that same day (each a 0-day interval).

    The window runs over one row per (user, item, day), so a (user, item)
    pair holding a third of all purchases still has at most one row per
    calendar day in its window partition.  ``next_date`` is NULL on the last
    day.  Together the rows hold every interval of the per-item definition
    of O-32.
    """
    buys = user_item_purchases(actions)
    per_day = buys.groupBy("user_id", "item_id", "date").agg(count_actions(buys).alias("c"))
    nxt = F.lead("date").over(Window.partitionBy("user_id", "item_id").orderBy("date"))
    return per_day.select(
        "user_id",
        "item_id",
        "date",
        nxt.alias("next_date"),
        F.datediff(nxt, F.col("date")).alias("days_to_next"),
        (F.col("c") - 1).alias("repeats"),
    )


def repurchase_mean_by_user(actions: DataFrame) -> DataFrame:
    """O-32: mean interval between repeat purchases of the same item, per user.

    For one (user, item) the intervals between consecutive purchase dates sum
    to ``last - first`` and there are ``n - 1`` of them, so the per-user mean
    of all intervals is ``sum(last - first) / sum(n - 1)`` -- two mergeable
    aggregates instead of a window over every purchase.  Users with no
    repeated item are absent.  ``avg_days_trunc`` is the integer mean
    (``sum div count``).
    """
    buys = user_item_purchases(actions)
    per_item = buys.groupBy("user_id", "item_id").agg(
        count_actions(buys).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    per_user = per_item.groupBy("user_id").agg(
        F.sum(F.datediff("last", "first")).alias("total_days"),
        F.sum(F.col("n") - 1).alias("intervals"),
    )
    return per_user.where(F.col("intervals") > 0).select(
        "user_id",
        (F.col("total_days").cast("double") / F.col("intervals")).alias("avg_days"),
        F.expr("total_days div intervals").alias("avg_days_trunc"),
    )


def repurchase_gap_histogram(actions: DataFrame) -> DataFrame:
    """O-33: number of gaps of each length (O-30 gaps)."""
    return repurchase_gaps(actions).groupBy("gap_days").agg(F.count(F.lit(1)).alias("n"))


def repurchase_gap_cumulative(actions: DataFrame) -> DataFrame:
    """O-34: histogram plus the running share of gaps up to each length."""
    return cumulative_share(repurchase_gap_histogram(actions))


def cumulative_share(hist: DataFrame) -> DataFrame:
    """``gap_days, n, cum_share`` of a histogram ``gap_days, n``.

    The running sum is an unpartitioned window, but over the histogram: at
    most one row per distinct gap length, which is bounded by the number of
    days the log spans, never by its rows.
    """
    # Same ordering, two frames: one Window operator computes both sums.
    ordered = Window.orderBy("gap_days")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hist.select(
        "gap_days",
        "n",
        (F.sum("n").over(running).cast("double") / F.sum("n").over(everything)).alias("cum_share"),
    )
