"""Random action logs: operators against plain-Python definitions."""

import datetime as dt
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.operators import funnel, repurchase, traffic, value
from shopflow.schema import ACTIONS

D0 = dt.date(2014, 12, 10)

row = st.tuples(
    st.one_of(st.none(), st.integers(1, 4)),  # user (NULL allowed)
    st.one_of(st.none(), st.integers(1, 3)),  # item (NULL allowed)
    st.integers(0, 4),  # behaviour code
    st.integers(0, 6),  # day offset
    st.integers(0, 23),  # hour
)


def frame(spark, rows):
    data = []
    for u, i, b, d, h in rows:
        day = D0 + dt.timedelta(days=d)
        data.append((u, i, b, None if i is None else i // 2, dt.datetime.combine(day, dt.time(h)), day, h))
    return spark.createDataFrame(data, ACTIONS)


def brute(rows):
    by_date = defaultdict(list)
    for r in rows:
        by_date[D0 + dt.timedelta(days=r[3])].append(r)
    pvuv = {d: (len(rs), len({r[0] for r in rs if r[0] is not None})) for d, rs in by_date.items()}
    arpu, arppu, paying = {}, {}, {}
    for d, rs in by_date.items():
        users = {r[0] for r in rs if r[0] is not None}
        buys = [r for r in rs if r[2] == 4]
        payers = {r[0] for r in buys if r[0] is not None}
        arpu[d] = len(buys) / len(users) if users else 0.0
        paying[d] = len(payers) / len(users) if users else 0.0
        if buys and payers:
            arppu[d] = len(buys) / len(payers)
    purchases = defaultdict(list)  # user -> sorted purchase days (every purchase)
    per_item = defaultdict(list)
    for u, i, b, d, h in rows:
        if b == 4 and u is not None:
            purchases[u].append(d)
            if i is not None:
                per_item[(u, i)].append(d)
    lists, gaps = {}, set()
    for u, days in purchases.items():
        days.sort()
        lists[u] = ",".join(str(b - a) for a, b in zip(days, days[1:]))
        distinct = sorted(set(days))
        for a, b in zip(distinct, distinct[1:]):
            gaps.add((u, D0 + dt.timedelta(days=b), b - a))
    diffs = defaultdict(list)
    for (u, _), days in per_item.items():
        days.sort()
        diffs[u] += [b - a for a, b in zip(days, days[1:])]
    mean = {u: (sum(x) / len(x), sum(x) // len(x)) for u, x in diffs.items() if x}
    codes = [r[2] for r in rows]
    browse, interest, buy = codes.count(1), codes.count(2) + codes.count(3), codes.count(4)
    rates = (
        100.0 * interest / browse if browse else None,
        100.0 * buy / browse if browse else None,
        100.0 * buy / interest if interest else None,
    )
    return pvuv, arpu, arppu, paying, lists, gaps, mean, rates


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=0, max_size=40))
def test_operators_match_definitions(spark, rows):
    A = frame(spark, rows).cache()
    pvuv, arpu, arppu, paying, lists, gaps, mean, rates = brute(rows)

    assert {r["date"]: (r["pv"], r["uv"]) for r in traffic.pv_uv_by_date(A).collect()} == pvuv
    got = {r["date"]: r["arpu"] for r in value.arpu_by_date(A).collect()}
    assert got.keys() == arpu.keys() and all(near(got[k], arpu[k]) for k in got)
    got = {r["date"]: r["arppu"] for r in value.arppu_by_date(A).collect()}
    assert got.keys() == arppu.keys() and all(near(got[k], arppu[k]) for k in got)
    got = {r["date"]: r["paying_ratio"] for r in value.paying_ratio_by_date(A).collect()}
    assert got.keys() == paying.keys() and all(near(got[k], paying[k]) for k in got)
    assert {r["user_id"]: r["gaps"] for r in repurchase.repurchase_gap_lists(A).collect()} == lists
    assert {tuple(r) for r in repurchase.repurchase_gaps(A).collect()} == gaps
    got = {r["user_id"]: (r["avg_days"], r["avg_days_trunc"]) for r in repurchase.repurchase_mean_by_user(A).collect()}
    assert got.keys() == mean.keys()
    assert all(near(got[u][0], mean[u][0]) and got[u][1] == mean[u][1] for u in got)
    f = funnel.funnel_rates(A).first()
    assert all(near(a, b) for a, b in zip(f, rates))
    A.unpersist()


def brute_more(rows):
    buys = [r for r in rows if r[2] == 4 and r[0] is not None]
    per_user_days = defaultdict(set)
    per_user_count = defaultdict(int)
    per_day_count = defaultdict(int)
    per_item_day = defaultdict(int)
    for u, i, b, d, h in buys:
        per_user_days[u].add(d)
        per_user_count[u] += 1
        per_day_count[(u, d)] += 1
        if i is not None:
            per_item_day[(u, i, d)] += 1
    purchasers = len(per_user_days)
    repeat = sum(1 for s in per_user_days.values() if len(s) > 1)
    rate = (purchasers, repeat, repeat / purchasers if purchasers else None)
    runs = set()
    for u, days in per_user_days.items():
        prev = None
        for d in sorted(days):
            runs.add((u, D0 + dt.timedelta(days=d), None if prev is None else d - prev, per_day_count[(u, d)] - 1))
            prev = d
    intervals = set()
    by_pair = defaultdict(list)
    for (u, i, d), c in per_item_day.items():
        by_pair[(u, i)].append((d, c))
    for (u, i), lst in by_pair.items():
        lst.sort()
        for k, (d, c) in enumerate(lst):
            nxt = lst[k + 1][0] if k + 1 < len(lst) else None
            intervals.add((u, i, D0 + dt.timedelta(days=d),
                           None if nxt is None else D0 + dt.timedelta(days=nxt),
                           None if nxt is None else nxt - d, c - 1))
    pivot = defaultdict(lambda: [0, 0, 0, 0])
    for u, i, b, d, h in rows:
        pivot[h]
        if 1 <= b <= 4:
            pivot[h][b - 1] += 1
    counts = defaultdict(int)
    for r in rows:
        counts[r[2]] += 1
    buckets = defaultdict(int)
    for c in per_user_count.values():
        lo = 1 if c < 2 else 2 if c < 4 else 4
        buckets[lo] += 1
    return rate, runs, intervals, {h: tuple(v) for h, v in pivot.items()}, dict(counts), dict(buckets)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=0, max_size=40))
def test_more_operators_match_definitions(spark, rows):
    A = frame(spark, rows).cache()
    rate, runs, intervals, pivot, counts, buckets = brute_more(rows)
    r = repurchase.repeat_buy_rate(A).first()
    assert (r["purchasers"], r["repeat_purchasers"]) == rate[:2] and near(r["repeat_rate"], rate[2])
    assert {tuple(x) for x in repurchase.repurchase_gap_runs(A).collect()} == runs
    assert {tuple(x) for x in repurchase.repurchase_item_intervals(A).collect()} == intervals
    assert {x["hour"]: (x["b1"], x["b2"], x["b3"], x["b4"]) for x in traffic.pv_behavior_pivot(A).collect()} == pivot
    assert {x["behavior_type"]: x["n"] for x in traffic.behavior_counts(A).collect()} == counts
    got = {x["bucket_lo"]: x["users"] for x in value.buy_count_distribution(A, (2, 4)).collect()}
    assert got == buckets
    A.unpersist()
