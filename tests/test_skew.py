"""Every query on skewed copies of the driver's tables.

One user gets a third of all events, one customer a third of all orders and
one order a third of all line items (SURVEY: a single key may hold a third
of the rows).  Results must still
match the DuckDB forms exactly; nothing is capped or sampled.
"""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF_CHECK
from oracle_compare import compare, duck
from shopflow.plans.catalog import QUERIES

HOT = 0


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skewed"))
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    ev.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(HOT).cast("bigint"))
                  .otherwise(F.col("user_id"))).write.parquet(f"{out}/events.parquet")
    od = spark.read.parquet(f"{SF_CHECK}/orders.parquet")
    od.withColumn("o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.lit(HOT).cast("bigint"))
                  .otherwise(F.col("o_custkey"))).write.parquet(f"{out}/orders.parquet")
    # A third of all line items belong to one order (a hot join key).
    li = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    hot_order = od.agg(F.min("o_orderkey")).first()[0]
    li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(hot_order).cast("bigint"))
                  .otherwise(F.col("l_orderkey"))).write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.fixture(scope="module")
def con(skewed):
    return duck(skewed)


def test_hot_keys_hold_a_third(spark, skewed):
    ev = spark.read.parquet(f"{skewed}/events.parquet")
    share = ev.where(F.col("user_id") == HOT).count() / ev.count()
    assert 0.25 < share < 0.45
    li = spark.read.parquet(f"{skewed}/lineitem.parquet")
    top = li.groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    assert 0.25 < top / li.count() < 0.45


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle_under_skew(spark, skewed, con, key):
    problems = compare(spark, key, skewed, E.queries(), E.oracle_sql(), con)
    assert not problems, problems
