"""Funnel conversion: browse -> interest (favourite or cart) -> buy.

``funnel_*`` compare the totals of each step; ``ordered_funnel*`` follow each
user through the steps in time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.columns import percent, ratio
from shopflow.schema import BROWSE, BUY, CART, FAVOURITE, behavior_is, count_actions_if, on_day

#: The steps that a user takes one after another, and the behaviours that are one.
STEPS = {"browse": (BROWSE,), "interest": (FAVOURITE, CART), "buy": (BUY,)}


def funnel_counts(actions: DataFrame, day=None) -> DataFrame:
    """One row: browse, interest (favourite + cart) and buy counts.

    Conditional counts by code, so a missing behaviour gives 0 instead of
    shifting positions.  A global aggregate: one partial row per map task.
    """
    rows = actions if day is None else on_day(actions, day)
    code = F.col("behavior_type")
    return rows.agg(
        count_actions_if(rows, code == F.lit(BROWSE)).alias("browse"),
        count_actions_if(rows, code.isin(FAVOURITE, CART)).alias("interest"),
        count_actions_if(rows, code == F.lit(BUY)).alias("buy"),
    )


def funnel_rates(actions: DataFrame, day=None) -> DataFrame:
    """O-11 / O-12: conversion rates in percent; a zero denominator gives NULL."""
    c = funnel_counts(actions, day)
    return c.select(
        percent("interest", "browse").alias("interest_rate"),
        percent("buy", "browse").alias("buy_rate"),
        percent("buy", "interest").alias("interest_to_buy_rate"),
    )


def funnel_step_loss(actions: DataFrame, day=None) -> DataFrame:
    """O-13: share lost at each step, and which step loses the most.

    ``loss = 1 - next / previous``; it may be negative when a later step has
    more actions than the one before (not clamped).  The largest loss is found
    inside the one-row frame before it is split into rows.
    """
    c = funnel_counts(actions, day)
    losses = c.select(
        (F.lit(1.0) - ratio("interest", "browse")).alias("l1"),
        (F.lit(1.0) - ratio("buy", "interest")).alias("l2"),
    ).withColumn("top", F.greatest("l1", "l2"))
    steps = losses.select(
        F.inline(
            F.array(
                F.struct(F.lit("browse_to_interest").alias("step"), F.col("l1").alias("loss"), F.col("top")),
                F.struct(F.lit("interest_to_buy").alias("step"), F.col("l2").alias("loss"), F.col("top")),
            )
        )
    )
    return steps.select(
        "step",
        "loss",
        F.coalesce(F.col("loss") == F.col("top"), F.lit(False)).alias("is_largest"),
    )


def ordered_funnel_times(actions: DataFrame, day=None, steps: dict[str, tuple] = STEPS) -> DataFrame:
    """O-13 by user: the first time of each step at or after the step before.

    ``user_id`` and one time per step, for every known user who took the first
    step; NULL from the step that was not reached on.  The first browsing
    counts, then the first sign of interest from then on, and so on: a user
    who can be led through the steps in order at all is led so.  Times are
    date and hour, which every log line has; the order within an hour is
    unknown and counts as the steps' own.

    The rows are first reduced to one per (user, step, hour) with a map-side
    combine, so a user who holds a third of the log is at most its hours times
    the steps here.  The conditional minima are then taken one after another
    in windows over the user, which share one shuffle and one sort.
    """
    rows = actions if day is None else on_day(actions, day)
    at = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    is_step = [reduce(or_, [behavior_is(rows, c) for c in codes]) for codes in steps.values()]
    number = F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in enumerate(is_step)])
    known = rows.where(reduce(or_, is_step) & F.col("user_id").isNotNull())
    now = known.select("user_id", number.alias("step"), at.alias("at")).distinct()
    user = Window.partitionBy("user_id")
    before = None
    for i, name in enumerate(steps):
        fits = F.col("step") == i
        if before is not None:
            fits = fits & (F.col("at") >= F.col(before))
        now = now.withColumn(f"_{name}", F.min(F.when(fits, F.col("at"))).over(user))
        before = f"_{name}"
    first = F.col(f"_{next(iter(steps))}")
    # The times are the same in all rows of a user: any of them will do.
    return now.where(first.isNotNull()).groupBy("user_id").agg(*[F.max(f"_{name}").alias(name) for name in steps])


def ordered_funnel(actions: DataFrame, day=None, steps: dict[str, tuple] = STEPS) -> DataFrame:
    """O-13 in order: how many users reach each step, and where most are lost.

    One row per step: ``users`` who reach it, the ``loss`` against the step
    before (NULL for the first one and after a step that nobody reached),
    whether that is the largest, and ``mean_hours`` from the step before.
    """
    times = ordered_funnel_times(actions, day, steps)
    names = list(steps)
    hours = [F.timestamp_diff("HOUR", F.col(a), F.col(b)) for a, b in zip(names, names[1:])]
    counts = times.agg(
        *[F.count(n).alias(f"u{i}") for i, n in enumerate(names)],
        *[F.sum(h).alias(f"h{i + 1}") for i, h in enumerate(hours)],
    )
    losses = counts.select("*", *[(F.lit(1.0) - ratio(f"u{i}", f"u{i - 1}")).alias(f"l{i}") for i in range(1, len(names))])
    top = F.greatest(*[F.col(f"l{i}") for i in range(1, len(names))], F.lit(None).cast("double"))

    def row(i: int):
        none = F.lit(None).cast("double")
        loss = F.col(f"l{i}") if i else none
        wait = ratio(f"h{i}", f"u{i}") if i else none
        return F.struct(
            F.lit(names[i]).alias("step"), F.col(f"u{i}").alias("users"), loss.alias("loss"),
            F.coalesce(loss == top, F.lit(False)).alias("is_largest"), wait.alias("mean_hours"),
        )

    return losses.select(F.inline(F.array(*[row(i) for i in range(len(names))])))
