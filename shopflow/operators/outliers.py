"""Outliers by distribution (P-6): groups of actions that are far too many.

Beside the range checks of single fields, a log may hold users who act more
often than any person does: crawlers, test accounts, doubled files.  The
actions per group (by default a known user's hour) are counted, and rules on
the distribution of these counts give the cuts beyond which a group is an
outlier:

* ``q99`` and ``q999``: the smallest count that 99 % (99.9 %) of the groups
  do not exceed;
* ``iqr``: the third quartile plus one and a half times the distance of the quartiles;
* ``mean_3sd``: the mean plus three standard deviations.

All of them are read off the histogram of the counts: one row per distinct
count, at most the square root of twice the actions.  Its running sums are
exact, so the quantiles are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.columns import ratio
from shopflow.schema import count_actions

USER_HOUR = ("user_id", "date", "hour")
#: Quantiles that the rules use, in ten-thousandths.
_QUANTILES = {"q25": 2500, "q75": 7500, "q99": 9900, "q999": 9990}


def activity(actions: DataFrame, keys: tuple[str, ...] = USER_HOUR) -> DataFrame:
    """``keys, n``: the actions of each group; unknown users are in none."""
    known = actions.where(F.col("user_id").isNotNull()) if "user_id" in keys else actions
    return known.groupBy(*keys).agg(count_actions(known).alias("n"))


def activity_cuts(actions: DataFrame, keys: tuple[str, ...] = USER_HOUR) -> DataFrame:
    """One row per rule: ``rule, cut, n_groups, n_actions``, the groups beyond the cut and their actions.

    Without any group the cuts are NULL and the counts 0.
    """
    hist = activity(actions, keys).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    # Windows without partition over the histogram only.
    every = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.withColumns(
        {
            "running": F.sum("groups").over(running),
            "total": F.sum("groups").over(every),
            "s1": F.sum(F.col("groups") * F.col("n")).over(every).cast("double"),
            "s2": F.sum(F.col("groups").cast("double") * F.col("n") * F.col("n")).over(every),
        }
    )
    at = sums.withColumns({name: F.min(F.when(F.col("running") * 10_000 >= F.col("total") * q, F.col("n"))).over(every).cast("double") for name, q in _QUANTILES.items()})
    mean = ratio("s1", "total")
    spread = F.sqrt(F.greatest(ratio("s2", "total") - mean * mean, F.lit(0.0)))
    cuts = {
        "q99": F.col("q99"),
        "q999": F.col("q999"),
        "iqr": F.col("q75") + F.lit(1.5) * (F.col("q75") - F.col("q25")),
        "mean_3sd": mean + F.lit(3.0) * spread,
    }
    told = at.select("n", "groups", *[c.alias(rule) for rule, c in cuts.items()])
    one = told.agg(
        *[F.max(rule).alias(rule) for rule in cuts],
        *[F.coalesce(F.sum(F.when(F.col("n") > F.col(rule), F.col("groups"))), F.lit(0).cast("bigint")).alias(f"g_{rule}") for rule in cuts],
        *[F.coalesce(F.sum(F.when(F.col("n") > F.col(rule), F.col("groups") * F.col("n"))), F.lit(0).cast("bigint")).alias(f"a_{rule}") for rule in cuts],
    )
    rows = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("cut"), F.col(f"g_{r}").alias("n_groups"), F.col(f"a_{r}").alias("n_actions")) for r in cuts]
    return one.select(F.inline(F.array(*rows)))


def outlier_groups(actions: DataFrame, rule: str = "q999", keys: tuple[str, ...] = USER_HOUR) -> DataFrame:
    """``keys, n, cut``: the groups beyond the rule's cut."""
    cut = activity_cuts(actions, keys).where(F.col("rule") == rule).select("cut").scalar()
    return activity(actions, keys).withColumn("cut", cut).where(F.col("n") > F.col("cut"))


def without_outliers(actions: DataFrame, rule: str = "q999", keys: tuple[str, ...] = USER_HOUR) -> DataFrame:
    """The actions that are in no outlier group; those of unknown users stay.

    The outliers are the smaller side of an anti-join by their keys, which
    Spark broadcasts if they are few.
    """
    return actions.join(outlier_groups(actions, rule, keys).select(*keys), list(keys), "left_anti")
