"""Adapter ``orders JOIN lineitem -> ACTIONS`` (purchases only).

Every line item is one purchase action: the customer is the user, the part
is the item, the order date is the day.  This feeds the purchase-side
operators (user value, repurchase) from the two largest tables.

Plan at scale: both inputs are pruned to the key and the columns used.
Without items, line items are counted per order before the join, so the
largest shuffle carries map-side combined counts and arrives hash-partitioned
by order key: the sort-merge join then shuffles only ``orders``.  Neither
side has a size bound, so no broadcast is forced; Spark broadcasts only under
its size-checked threshold, and adaptive execution splits a skewed order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.schema import BUY, WEIGHT
from shopflow.sources.events import table_path


def purchases_from_orders(orders: DataFrame, lineitem: DataFrame, items: bool = True) -> DataFrame:
    """Purchase ACTIONS from orders and their line items.

    ``items=True``: one row per line item, with ``item_id``.  ``items=False``:
    line items are first counted per order (a map-side combined aggregate, so
    the shuffle carries one row per order and task instead of every line),
    and each order becomes one row with ``n_actions`` = its line count; the
    operators count ``n_actions``, so every metric that needs no item gives
    the same result from either form.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    if items:
        li = lineitem.select("l_orderkey", "l_partkey")
    else:
        li = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias(WEIGHT))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    when = F.col("o_orderdate").cast("timestamp_ntz")
    cols = [F.col("o_custkey").alias("user_id")]
    if items:
        cols += [F.col("l_partkey").alias("item_id"), F.lit(None).cast("bigint").alias("item_category")]
    cols += [
        F.lit(BUY).cast("int").alias("behavior_type"),
        when.alias("time"),
        F.to_date(when).alias("date"),
        F.hour(when).alias("hour"),
    ]
    if not items:
        cols.append(F.col(WEIGHT))
    return j.select(*cols)


def read_order_purchases(spark: SparkSession, sf_dir: str, items: bool = True) -> DataFrame:
    return purchases_from_orders(
        spark.read.parquet(table_path(sf_dir, "orders")),
        spark.read.parquet(table_path(sf_dir, "lineitem")),
        items=items,
    )
