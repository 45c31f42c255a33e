"""The hand-made action log (FIXTURES.md §3): expected values written out."""

import datetime as dt
import os

import pytest

from shopflow.operators import funnel, profile, repurchase, traffic, value
from shopflow.sources.text_log import read_log, rejected_counts

HEADER = "user_id,item_id,behavior_type,item_category,time,date,hour"
GOOD = [
    "10,100,1,5,2014-12-11 09,2014-12-11,9",
    "10,100,4,5,2014-12-11 10,2014-12-11,10",
    "10,100,4,5,2014-12-11 10,2014-12-11,10",
    "10,101,4,6,2014-12-14 20,2014-12-14,20",
    "10,100,4,5,2014-12-16 20,2014-12-16,20",
    "11,100,1,5,2014-12-12 20,2014-12-12,20",
    "11,101,2,6,2014-12-12 20,2014-12-12,20",
    "11,101,3,6,2014-12-12 21,2014-12-12,21",
    "11,101,4,6,2014-12-12 21,2014-12-12,21",
    "12,102,1,6,2014-12-13 20,2014-12-13,20",
    "12,102,1,6,2014-12-12 07,2014-12-12,7",
    ",100,1,5,2014-12-12 20,2014-12-12,20",
]
BAD = [
    "10,100,4,5,2014-12-11 10",
    "11,100,x,5,2014-12-12 20,2014-12-12,20",
    "11,100,9,5,2014-12-12 20,2014-12-12,20",
    "10,100,4,5,2014-12-11 10,2014-12-11,10,9",
]
D = dt.date(2014, 12, 12)


def d(s):
    return dt.date.fromisoformat(s)


def write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("log") / "user_action.csv"
    write(p, [HEADER, *GOOD, HEADER, *BAD])
    good, rejects = read_log(spark, str(p), layout=7)
    return good, rejects


@pytest.fixture(scope="module")
def actions(log):
    return log[0].cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_good_and_rejects(log):
    good, rejects = log
    assert good.count() == 12
    assert rows(rejected_counts(rejects), "reason", "n") == [("behavior_type", 2), ("field_count", 2)]


def test_count_agrees_with_collect(log):
    # Pruned count must still apply the row checks (no DROPMALFORMED trap).
    good, _ = log
    assert good.count() == len(good.collect())
    assert good.select("date").count() == 12
    assert sum(r["n"] for r in good.groupBy("user_id").count().withColumnRenamed("count", "n").collect()) == 12


def test_five_column_layout_is_identical(spark, tmp_path, actions):
    five = [",".join(line.split(",")[:5]) for line in GOOD]
    p = write(tmp_path / "five.csv", [",".join(HEADER.split(",")[:5]), *five])
    good5, rej5 = read_log(spark, str(p), layout=5)
    assert rej5.count() == 0
    cols = list(good5.columns)
    assert good5.exceptAll(actions.select(cols)).count() == 0
    assert actions.select(cols).exceptAll(good5).count() == 0


def test_profile(actions):
    r = profile.dataset_profile(actions).first()
    assert (r["rows"], r["users"], r["items"], r["categories"]) == (12, 3, 3, 2)
    miss = dict(rows(profile.missing_profile(actions), "column_name", "n_missing"))
    assert miss == {"user_id": 1, "item_id": 0, "behavior_type": 0, "item_category": 0,
                    "time": 0, "date": 0, "hour": 0}


def test_pv_uv(actions):
    assert rows(traffic.pv_uv_by_date(actions), "date", "pv", "uv") == [
        (d("2014-12-11"), 3, 1), (d("2014-12-12"), 6, 2), (d("2014-12-13"), 1, 1),
        (d("2014-12-14"), 1, 1), (d("2014-12-16"), 1, 1)]
    assert rows(traffic.pv_uv_by_hour(actions), "hour", "pv", "uv") == [
        (7, 1, 1), (9, 1, 1), (10, 2, 1), (20, 6, 3), (21, 2, 1)]
    expected_day = [(7, 1, 1), (20, 3, 1), (21, 2, 1)]
    assert rows(traffic.pv_uv_by_hour_on_day(actions, D), "hour", "pv", "uv") == expected_day
    assert rows(traffic.pv_uv_join_on_day(actions, D), "hour", "pv", "uv") == expected_day
    assert rows(traffic.pv_by_date(actions), "date", "pv")[1] == (D, 6)
    assert rows(traffic.uv_by_hour(actions), "hour", "uv")[3] == (20, 3)


def test_behavior(actions):
    assert rows(traffic.pv_by_behavior_hour(actions), "behavior_type", "hour", "pv") == [
        (1, 7, 1), (1, 9, 1), (1, 20, 3), (2, 20, 1), (3, 21, 1), (4, 10, 2), (4, 20, 2), (4, 21, 1)]
    assert rows(traffic.behavior_counts(actions), "behavior_type", "n") == [(1, 5), (2, 1), (3, 1), (4, 5)]
    piv = rows(traffic.pv_behavior_pivot(actions), "hour", "b1", "b2", "b3", "b4")
    assert piv == [(7, 1, 0, 0, 0), (9, 1, 0, 0, 0), (10, 0, 0, 0, 2), (20, 3, 1, 0, 2), (21, 0, 0, 1, 1)]


def test_funnel(actions):
    r = funnel.funnel_rates(actions).first()
    assert (r["interest_rate"], r["buy_rate"], r["interest_to_buy_rate"]) == (40.0, 100.0, 250.0)
    loss = {x["step"]: (x["loss"], x["is_largest"]) for x in funnel.funnel_step_loss(actions).collect()}
    assert loss["browse_to_interest"] == (pytest.approx(0.6), True)
    assert loss["interest_to_buy"] == (pytest.approx(-1.5), False)


def test_value(actions):
    assert rows(value.buy_count_by_user(actions), "user_id", "buy_count") == [(10, 4), (11, 1)]
    assert rows(value.arpu_by_date(actions), "date", "arpu") == [
        (d("2014-12-11"), 2.0), (d("2014-12-12"), 0.5), (d("2014-12-13"), 0.0),
        (d("2014-12-14"), 1.0), (d("2014-12-16"), 1.0)]
    assert rows(value.arppu_by_date(actions), "date", "arppu") == [
        (d("2014-12-11"), 2.0), (d("2014-12-12"), 1.0), (d("2014-12-14"), 1.0), (d("2014-12-16"), 1.0)]
    assert rows(value.paying_ratio_by_date(actions), "date", "paying_ratio") == [
        (d("2014-12-11"), 1.0), (d("2014-12-12"), 0.5), (d("2014-12-13"), 0.0),
        (d("2014-12-14"), 1.0), (d("2014-12-16"), 1.0)]


def test_buy_count_distribution(actions):
    got = rows(value.buy_count_distribution(actions, bounds=(2, 3, 5)), "bucket_lo", "bucket", "users")
    assert got == [(1, "[1,2)", 1), (3, "[3,5)", 1)]


def test_repurchase(actions):
    assert repurchase.repeat_buy_rate(actions).first()["repeat_rate"] == 0.5
    assert rows(repurchase.repurchase_gaps(actions), "user_id", "date", "gap_days") == [
        (10, d("2014-12-14"), 3), (10, d("2014-12-16"), 2)]
    assert rows(repurchase.repurchase_gap_lists(actions), "user_id", "gaps") == [(10, "0,3,2"), (11, "")]
    m = repurchase.repurchase_mean_by_user(actions).collect()
    assert [(r["user_id"], r["avg_days"], r["avg_days_trunc"]) for r in m] == [(10, 2.5, 2)]
    assert rows(repurchase.repurchase_gap_cumulative(actions), "gap_days", "n", "cum_share") == [
        (2, 1, 0.5), (3, 1, 1.0)]


def test_strict_mode_fails_on_reject(spark, tmp_path):
    p = write(tmp_path / "bad.csv", [HEADER, GOOD[0], BAD[1]])
    good, _ = read_log(spark, str(p), layout=7, mode="strict")
    with pytest.raises(Exception, match="rejected action-log line"):
        good.collect()
    p2 = write(tmp_path / "ok.csv", [HEADER, GOOD[0]])
    assert read_log(spark, str(p2), layout=7, mode="strict")[0].count() == 1


def test_gzip_log_spread(spark, tmp_path):
    import gzip

    p = tmp_path / "log.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join([HEADER, *GOOD, *BAD]) + "\n")
    good, rejects = read_log(spark, str(p), layout=7, spread=4)
    assert good.rdd.getNumPartitions() == 4
    assert good.count() == 12 and rejects.count() == 4
