"""Gap lists cut into parts: joined they are the list; no user is too long."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paths import SF_CHECK
from shopflow.operators import repurchase
from shopflow.plans.catalog import actions

SCHEMA = "user_id long, behavior_type int, date date, n_actions long"


def frame(spark, rows):
    return spark.createDataFrame([(u, 4, dt.date(2014, 12, 1) + dt.timedelta(days=d), n) for u, d, n in rows], SCHEMA)


@pytest.mark.parametrize("part", [1, 2, 7, 1000])
def test_parts_joined_are_the_list(spark, part):
    A = actions(spark, SF_CHECK)
    rows = repurchase.repurchase_gap_list_parts(A, part).collect()
    joined = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["part"])):
        own = joined.setdefault(r["user_id"], [])
        assert r["part"] == len(own) and r["n"] == (len(r["gaps"].split(",")) if r["gaps"] else 0)
        assert r["n"] <= part and (not own or own[-1].count(",") == part - 1)
        own.append(r["gaps"])
    assert {u: ",".join(p) for u, p in joined.items()} == {r["user_id"]: r["gaps"] for r in repurchase.repurchase_gap_lists(A).collect()}


def test_single_purchases_and_unknown_users(spark):
    got = repurchase.repurchase_gap_list_parts(frame(spark, [(1, 0, 1), (2, 0, 1), (2, 3, 1), (3, 1, 3), (None, 1, 5)]), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, ""), (2, 0, 1, "3"), (3, 0, 2, "0,0")]
    assert repurchase.repurchase_gap_list_parts(frame(spark, []), 2).count() == 0


def test_billions_of_purchases(spark):
    A = frame(spark, [(1, 0, 8_000_000_000), (1, 2, 2), (2, 0, 1)])
    parts = repurchase.repurchase_gap_list_parts(A, 500_000)
    counts = {r["user_id"]: (r["k"], r["total"]) for r in parts.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).collect()}
    assert counts == {1: (16_001, 8_000_000_001), 2: (1, 0)}
    ends = parts.where("user_id = 1 AND part >= 15999").select("part", F.length("gaps"), F.right("gaps", F.lit(4))).collect()
    assert sorted(map(tuple, ends)) == [(15_999, 999_999, ",0,2"), (16_000, 1, "0")]


def test_too_long_a_list_says_so(spark):
    days = [(1, d, 900_000_000) for d in range(3)]  # no single day is too long, all together are
    with pytest.raises(Exception, match="repurchase_gap_list_parts"):
        repurchase.repurchase_gap_lists(frame(spark, days)).collect()
