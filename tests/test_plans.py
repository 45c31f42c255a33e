"""Plan checks: filters reach the scan, no Python evaluation, no cartesian."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from paths import SF_CHECK
from shopflow.plans.catalog import QUERIES


def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_no_cartesian(spark, key):
    text = formatted(E.queries()[key](spark, SF_CHECK))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{key}: {bad}"


def test_day_filter_pushed(spark):
    text = formatted(E.queries()["pv_uv_by_hour_on_day"](spark, SF_CHECK))
    assert "GreaterThanOrEqual(ts,2024-01-12T00:00)" in text
    assert "LessThan(ts,2024-01-13T00:00)" in text


def test_buy_filter_pushed(spark):
    for key in ("buy_count_by_user", "arppu_by_date", "repurchase_gaps", "repurchase_mean_by_user",
                "repurchase_mean_by_user_sql", "repurchase_gap_lists_hourly"):
        text = formatted(E.queries()[key](spark, SF_CHECK))
        assert "EqualTo(event_type,purchase)" in text, key


def test_columns_pruned(spark):
    text = formatted(E.queries()["pv_uv_by_date"](spark, SF_CHECK))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_gap_list_reuses_window_partitioning(spark):
    text = formatted(E.queries()["repurchase_gap_lists"](spark, SF_CHECK))
    # (user, date) pre-aggregation, then one exchange on user for window + list.
    nodes = [ln for ln in text.splitlines() if re.match(r"^\(\d+\) Exchange", ln)]
    assert len(nodes) == 2
