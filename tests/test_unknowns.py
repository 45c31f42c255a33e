"""Unknown users and items, ids of any size, own behaviour codes, white space."""

import datetime as dt

import pytest

from shopflow.functions.ordering import by_frequency, in_order
from shopflow.operators import profile, repurchase, value
from shopflow.schema import ACTIONS
from shopflow.sources.events import from_events
from shopflow.sources.text_log import parse_lines

D = dt.date(2014, 12, 10)


def buys(spark, rows):
    data = [(u, i, 4, None, None, D + dt.timedelta(days=d), 8) for u, i, d in rows]
    return spark.createDataFrame(data, ACTIONS)


def test_anonymous_purchases_are_nobodys(spark):
    actions = buys(spark, [(1, 5, 0), (None, 5, 0), (None, 5, 3), (None, 5, 4)])
    rate = repurchase.repeat_buy_rate(actions).first()
    assert tuple(rate) == (1, 0, 0.0)
    assert repurchase.repurchase_gaps(actions).count() == 0
    assert repurchase.repurchase_gap_histogram(actions).count() == 0
    assert [tuple(r) for r in repurchase.repurchase_gap_lists(actions).collect()] == [(1, "")]
    assert [tuple(r) for r in value.buy_count_by_user(actions).collect()] == [(1, 1)]
    assert [r["users"] for r in value.buy_count_distribution(actions).collect()] == [1]
    assert [tuple(r) for r in value.arppu_by_date(actions).collect()] == [(D, 2.0)]  # days without payers are absent


def test_unknown_items_are_not_one_item(spark):
    actions = buys(spark, [(1, None, 0), (1, None, 2), (2, 5, 0), (2, 5, 2)])
    assert [(r["user_id"], r["avg_days"]) for r in repurchase.repurchase_mean_by_user(actions).collect()] == [(2, 2.0)]
    assert {r["user_id"] for r in repurchase.repurchase_item_intervals(actions).collect()} == {2}


def test_large_item_ids_stay_apart(spark):
    rows = [(k, 1, "purchase", dt.datetime(2024, 1, 1 + k), f'{{"k": {3_000_000_000 + k}}}') for k in range(3)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, props string")
    actions = from_events(events)
    assert profile.dataset_profile(actions).first()["items"] == 3
    assert repurchase.repurchase_mean_by_user(actions).count() == 0
    assert sorted(r["item_category"] for r in actions.collect()) == [300_000_000] * 3


def test_own_behaviour_codes(spark):
    numbers = ["1,7,1,3,2014-12-10 08,2014-12-10,8", "1,7,4,3,2014-12-10 09,2014-12-10,9", "2,7,3,3,2014-12-10 09,2014-12-10,9"]
    words = [x.replace(",1,3,", ",pv,3,").replace(",4,3,", ",buy,3,").replace(",3,3,", ",cart,3,") for x in numbers]
    lines = lambda rows: spark.createDataFrame([(x,) for x in rows], "value string")
    codes = {1: ("pv", "view"), 2: ("fav",), 3: ("cart",), 4: ("buy",)}
    want, _ = parse_lines(lines(numbers))
    got, rejects = parse_lines(lines([*words, words[0].replace("pv", "share")]), codes=codes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r["reason"] for r in rejects.collect()] == ["behavior_type"]
    events = spark.createDataFrame([(1, 1, "order", dt.datetime(2024, 1, 1), "{}")], "event_id long, user_id long, event_type string, ts timestamp_ntz, props string")
    assert from_events(events, {4: ("order",)}).first()["behavior_type"] == 4


@pytest.mark.parametrize("blank", ["", " ", "\t", "\t \x0b", "\xa0"])
def test_any_white_space_is_blank(spark, blank):
    line = f"{blank},7,1,3,2014-12-10 08,2014-12-10,8"
    lines = spark.createDataFrame([(line,)], "value string")
    good, rejects = parse_lines(lines)
    assert [r["user_id"] for r in good.collect()] == [None] and rejects.count() == 0
    counts = {r["column_name"]: r["n_missing"] for r in profile.log_profile(lines).collect()}
    assert counts["user_id"] == 1 and sum(v or 0 for v in counts.values()) == 1


def test_log_profile_sees_rejected_lines(spark):
    full = "1,7,1,3,2014-12-10 08,2014-12-10,8".split(",")
    rows = [",".join("" if j == k else x for j, x in enumerate(full)) for k in range(7)]
    rows += ["user_id,item_id,behavior_type,item_category,time,date,hour", "1,7"]
    got = {r["column_name"]: (r["n_missing"], r["n_rejected"]) for r in profile.log_profile(spark.createDataFrame([(x,) for x in rows], "value string")).collect()}
    assert got == {"field_count": (None, 1), "user_id": (1, 0), "item_id": (1, 0), "behavior_type": (2, 1), "item_category": (2, 0),
                   "time": (2, 0), "date": (2, 1), "hour": (2, 1)}


def test_orders(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), (None, 1)], "k string, n long").repartition(3)
    assert [r["k"] for r in in_order(df, "k").collect()] == [None, "a", "b", "c"]
    assert [r["k"] for r in by_frequency(df, "n").collect()] == ["c", "a", "b", None]
