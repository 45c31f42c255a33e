"""Row numbers and running sums over a whole ordered table, without one task seeing all of it.

The rows are range-partitioned by the order, sorted within their partitions,
and each partition's offset comes from the sums of the partitions before it:
a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def running_sum(df: DataFrame, order: list[str], amount: str, out: str, partitions: int | None = None) -> DataFrame:
    """``out``: the sum of ``amount`` over all earlier rows by ``order`` (ascending, nulls first).

    ``order`` must be unique over the rows for a result that does not depend
    on the partitioning.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    # Written once: the partition ids of a second evaluation could differ.
    dealt = staged(dealt)
    totals = dealt.groupBy("_pid").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: at most ``n`` rows are broadcast.
    return (
        dealt.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(amount).over(own), F.lit(0)))
        .drop("_pid", "_offset")
    )


def row_number(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """``out``: the number of earlier rows by ``order``, from 0."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out, partitions).drop("_one")


def hashed(*parts: Column, seed: int = 0) -> Column:
    """A seeded pseudo-random long that depends on the values only."""
    return F.xxhash64(F.lit(seed), *parts)
