"""Random log lines: the Spark parser against a plain-Python statement of its rules."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.sources.text_log import parse_all

H5 = "user_id,item_id,behavior_type,item_category,time"
H7 = H5 + ",date,hour"
ID = st.one_of(st.just(""), st.just(" "), st.from_regex(r"[0-9]{1,6}", fullmatch=True), st.just("x1"), st.just("-3"))
CODE = st.one_of(st.sampled_from(["1", "2", "3", "4", "0", "9", "", "a"]))
DAY = st.one_of(
    st.dates(dt.date(2014, 1, 1), dt.date(2015, 12, 31)).map(lambda d: d.isoformat()),
    st.sampled_from(["2014-02-30", "2014/12/11", "", "2014-1-5"]),
)
HOUR = st.one_of(st.integers(0, 23).map(str), st.sampled_from(["24", "-1", "", "07", "x"]))


@st.composite
def line(draw, layout):
    day, hour = draw(DAY), draw(HOUR)
    time = draw(st.one_of(st.just(f"{day} {hour}"), st.just(""), st.just(day)))
    fields = [draw(ID), draw(ID), draw(CODE), draw(ID), time]
    if layout == 7:
        fields += [draw(DAY), draw(HOUR)]
    n = draw(st.sampled_from([layout, layout, layout, layout - 1, layout + 1]))
    fields = (fields + ["9"] * 2)[:n]
    return ",".join(f" {f} " if draw(st.booleans()) and f else f for f in fields)


def _int(s, lo=None, hi=None):
    if s is None or not re.fullmatch(r"-?[0-9]+", s):
        return None
    v = int(s)
    return v if (lo is None or lo <= v <= hi) else None


def _date(s):
    if s is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        return None
    try:
        return dt.date.fromisoformat(s)
    except ValueError:
        return None


def rule(text, layout):
    """(reason, values) for one line, or None for a header."""
    fields = text.split(",")
    f = [(x.strip(" ") or None) for x in fields] + [None] * 7
    user = _int(f[0])
    if user is None and text.strip(" ").lower() in (H5, H7):
        return None
    item, code, cat = _int(f[1]), _int(f[2]), _int(f[3])
    t = f[4]
    t_ok = bool(t and re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{1,2}", t))
    t_day = _date(t[:10]) if t_ok else None
    t_hour = _int(t[11:], 0, 23) if t_ok else None
    t_ok = t_day is not None and t_hour is not None
    if layout == 7:
        date, hour, time_bad = _date(f[5]), _int(f[6], 0, 23), t is not None and not t_ok
    else:
        date, hour, time_bad = (t_day, t_hour, not t_ok) if t_ok else (None, None, True)
    checks = [
        ("field_count", len(fields) != layout),
        ("user_id", f[0] is not None and user is None),
        ("item_id", f[1] is not None and item is None),
        ("behavior_type", code not in (1, 2, 3, 4)),
        ("item_category", f[3] is not None and cat is None),
        ("time", time_bad),
        ("date", date is None),
        ("hour", hour is None),
    ]
    reason = next((name for name, bad in checks if bad), None)
    values = None
    if reason is None:
        when = dt.datetime.combine(t_day, dt.time(t_hour)) if t_ok else None
        values = (user, item, code, cat, when, date, hour)
    return reason, values


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(layout=st.sampled_from([5, 7]), data=st.data())
def test_parser_matches_rules(spark, layout, data):
    lines = data.draw(st.lists(line(layout), min_size=1, max_size=60))
    lines.append(H7 if layout == 7 else H5)
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {}
    for r in parse_all(df, layout=layout).collect():
        vals = None if r["reason"] else (r["user_id"], r["item_id"], r["behavior_type"], r["item_category"],
                                         r["time"], r["date"], r["hour"])
        got.setdefault(r["line"], set()).add((r["reason"], vals))
    want = {}
    for x in lines:
        res = rule(x, layout)
        if res is not None:
            want.setdefault(x, set()).add(res)
    assert got == want
