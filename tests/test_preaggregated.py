"""Operators on a pre-aggregated table (one row per date, hour, user,
behaviour with ``n_actions``) give exactly the raw-log results."""

import pytest

from paths import SF_CHECK
from shopflow.operators import funnel, repurchase, traffic, value
from shopflow.plans.catalog import DAY, actions
from shopflow.schema import pre_aggregate
from test_fixture_log import BAD, GOOD, HEADER, write

OPS = [
    traffic.pv_by_date, traffic.uv_by_date, traffic.pv_by_hour, traffic.uv_by_hour,
    traffic.pv_uv_by_date, traffic.pv_uv_by_hour, traffic.pv_by_behavior_hour,
    traffic.behavior_counts, traffic.pv_behavior_pivot,
    funnel.funnel_rates, funnel.funnel_step_loss,
    value.buy_count_by_user, value.actions_by_date_user_behavior, value.daily_consumption,
    value.arpu_by_date, value.buys_by_date_user, value.arppu_by_date, value.paying_ratio_by_date,
    value.buy_count_distribution,
    repurchase.pay_days_by_user, repurchase.repeat_buy_rate, repurchase.buys_by_user_date,
    repurchase.repurchase_gaps, repurchase.repurchase_gap_lists, repurchase.repurchase_gap_runs,
    repurchase.repurchase_gap_histogram, repurchase.repurchase_gap_cumulative,
]
DAY_OPS = [traffic.pv_uv_by_hour_on_day, traffic.pv_uv_join_on_day, traffic.hourly_day_vs_overall,
           traffic.behavior_counts, funnel.funnel_rates]


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module", params=["events", "log"])
def pair(spark, request, tmp_path_factory):
    if request.param == "events":
        raw = actions(spark, SF_CHECK)
        day = DAY
    else:
        from shopflow.sources.text_log import read_log

        p = write(tmp_path_factory.mktemp("pre") / "log.csv", [HEADER, *GOOD, *BAD])
        raw = read_log(spark, str(p), layout=7)[0]
        day = "2014-12-12"
    return raw, pre_aggregate(raw).cache(), day


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_same_result(pair, op):
    raw, pre, _ = pair
    same(op(raw), op(pre))


@pytest.mark.parametrize("op", DAY_OPS, ids=lambda f: f.__name__)
def test_same_result_on_day(pair, op):
    raw, pre, day = pair
    same(op(raw, day), op(pre, day))


def test_rows_profile(pair):
    from shopflow.operators import dataset_profile

    raw, pre, _ = pair
    assert dataset_profile(raw.select("user_id", "item_id", "item_category")).first()["rows"] == raw.count()
    assert pre.agg({"n_actions": "sum"}).first()[0] == raw.count()
