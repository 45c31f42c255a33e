"""Connected components as joins and aggregates, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the component's smallest node.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the
    edges no longer change; each step keeps the number of edges.  The minima
    are written before they are joined, so that both join sides are plain
    shuffles and a hub's edges can be split over tasks.  Edges that are
    loops, repeated or null add nothing.
    """
    now = staged(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    )
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = staged(both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = staged(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        linked = large.join(least, F.col("a") == F.col("u"))
        now = staged(
            linked.select("a", F.col("m").alias("b")).unionByName(linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        )
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
