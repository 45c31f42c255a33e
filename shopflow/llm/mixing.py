"""Mixing sources to target weights (8): Sainte-Laguë apportionment of equal-token blocks.

1. Each source's target is its weight's share of the total, at most
   ``epochs`` times its size; what is above is shared again by weight.
2. Every source is dealt into shards of bounded row count by a seeded hash,
   so that a source with a third of all rows is many shards.
3. Blocks of ``block`` words are allocated to all shards by the highest
   quotients target / (2k + 1).  Only the quotients near a shard's exact
   share can be decided either way, so only those are ranked.
4. In each shard the documents follow in a seeded order; its blocks are whole
   passes over the shard and then the first blocks of that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged
from .ranks import hashed, row_number


def word_count(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def weight_cycle(n: int = 3) -> "callable":
    """Weights 1..n by a source's place (from 0) in code point order, null last."""
    return lambda place: (place % n + 1).cast("double")


def source_targets(sources: DataFrame, weight=weight_cycle(), epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    The fill level L solves sum(min(weight * L, epochs * size)) = total.
    Sources are filled in the order of epochs * size / weight, so the level
    follows from running sums.  Windows run over one row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_at", "_place")
    placed = (
        sources.withColumn("_place", F.row_number().over(place) - 1)
        .withColumn("_w", weight(F.col("_place")))
        .withColumn("_cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("_at", F.col("_cap") / F.col("_w"))
    )
    whole = Window.partitionBy(F.lit(1))
    ahead = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = placed.withColumn("_total", F.sum("source_size").over(whole)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))) / F.sum("_w").over(rest)
    )
    # The first source that its cap does not stop fixes the level for all after it.
    open_level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_place", "_level"))).over(whole)
    return levels.withColumn("_open", open_level).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_open._level"), F.col("_cap"))).alias("target"),
    )


def sainte_lague(shares: DataFrame, seats: int, value: str, key: list[str], out: str) -> DataFrame:
    """``out``: how many of ``seats`` go to each row by the highest quotients value / (2k + 1).

    ``shares`` has unique ``key`` columns.  A row's seats differ from its
    exact share by at most 1 + its share of the rows, because moving the
    divisor moves all rows in proportion.  Seats below that range are given,
    those above are not, and those within are ranked: about six per row,
    however many the seats.  Equal quotients follow by key.
    """
    rows, total = shares.agg(F.count(F.lit(1)), F.sum(value)).first()
    if not rows or not total:
        return shares.withColumn(out, F.lit(0).cast("long"))
    exact = F.col(value) * (seats / total)
    slack = F.ceil(F.col(value) * (rows / total)) + 2
    ranged = staged(
        shares.withColumns({"_low": F.greatest(F.lit(0), F.floor(exact) - slack).cast("long"), "_high": (F.ceil(exact) + slack).cast("long")})
    )
    given = ranged.agg(F.sum("_low")).first()[0]
    open_seats = ranged.select(F.struct(*key).alias("_key"), value, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    quotients = open_seats.select("_key", "_k", (-F.col(value) / (2 * F.col("_k") + 1)).alias("_minus"))
    ranked = row_number(quotients, ["_minus", "_key", "_k"], "_rank")
    won = (
        ranked.filter(F.col("_rank") < seats - given).groupBy("_key").agg(F.count(F.lit(1)).alias("_won"))
        .select(*[F.col("_key")[k].alias(f"_k_{k}") for k in key], "_won")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return ranged.join(won, same, "left").select(*shares.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(out))


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weight=weight_cycle(),
    epochs: int = 3,
    block: int = 16,
    shard_rows: int = 4096,
    seed: int = 8,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``.

    Null texts have size 0 and are taken 0 times; null sources are one
    source, last in order; repeated rows are rows of their own; equal hashes
    follow by ``doc_id`` and then by size; a table without words has targets
    0; further columns are not read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sized = staged(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = staged(sources)
    targets = source_targets(sources.select("source", "source_size"), weight, epochs)
    targets = staged(targets.withColumnRenamed("source", "_s").join(sources.select("source", "_rows"), F.col("_s").eqNullSafe(F.col("source"))).drop("_s"))

    shards = F.ceil(F.col("_rows") / shard_rows).cast("long")
    # As many rows as there are sources; Spark broadcasts them by size or splits a skewed join.
    dealt = (
        sized.withColumnRenamed("source", "_s")
        .join(targets.withColumn("_shards", shards), F.col("_s").eqNullSafe(F.col("source")))
        .withColumn("shard", F.pmod(hashed(F.col("doc_id"), seed=seed), F.col("_shards")))
        .select("doc_id", "source", "size", "source_size", "target", "shard")
    )
    dealt = staged(dealt)
    parts = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    ).withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(F.lit(0.0)))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = sainte_lague(
        parts.select("source", "shard", "shard_size", "share"),
        round(words / block),
        "share",
        ["source", "shard"],
        "blocks",
    ).select(
        F.col("source").alias("_s"),
        F.col("shard").alias("_h"),
        "shard_size",
        F.least(F.col("blocks") * block, F.col("shard_size") * epochs).alias("words"),
    )
    order = Window.partitionBy("source", "shard").orderBy(hashed(F.col("doc_id"), seed=seed + 1), "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    return (
        dealt.join(quotas, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_h") == F.col("shard")))
        .withColumn("_before", before)
        .withColumn("_passes", passes)
        .withColumn("_rest", F.col("words") - F.col("_passes") * F.col("shard_size"))
        .select(
            "doc_id",
            "size",
            "source_size",
            F.col("target").cast("double").alias("target"),
            (F.col("_passes") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before")))).cast("long").alias("taken"),
        )
    )
