"""Invariants between metrics, on the driver's tables at every scale."""

import pytest
from pyspark.sql import functions as F

from paths import SF_BENCH, SF_CHECK, SF_SMALL
from shopflow.operators import repurchase, traffic, value
from shopflow.plans import sql_forms
from shopflow.plans.catalog import DAY, actions


@pytest.fixture(scope="module", params=[SF_SMALL, SF_CHECK, SF_BENCH])
def A(spark, request):
    return actions(spark, request.param)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_pv_sums_to_rows(A):
    n = A.count()
    assert total(traffic.pv_by_date(A), "pv") == n
    assert total(traffic.pv_by_hour(A), "pv") == n
    assert total(traffic.pv_by_behavior_hour(A), "pv") == n
    piv = traffic.pv_behavior_pivot(A)
    other = A.where("behavior_type = 0").count()
    assert total(piv, F.col("b1") + F.col("b2") + F.col("b3") + F.col("b4")) == n - other


def test_uv_at_most_pv(A):
    for df in (traffic.pv_uv_by_date(A), traffic.pv_uv_by_hour(A), traffic.pv_uv_by_hour_on_day(A, DAY)):
        assert df.where("uv > pv").count() == 0


def test_arpu_is_arppu_times_paying_ratio(A):
    arpu = value.arpu_by_date(A)
    arppu = value.arppu_by_date(A)
    pr = value.paying_ratio_by_date(A)
    j = arpu.join(arppu, "date").join(pr, "date").collect()
    assert j
    for r in j:
        assert r["arpu"] == pytest.approx(r["arppu"] * r["paying_ratio"])


def test_sum_arpu_times_uv_is_purchases(A):
    j = value.arpu_by_date(A).join(traffic.uv_by_date(A), "date")
    got = total(j, F.col("arpu") * F.col("uv"))
    assert got == pytest.approx(A.where("behavior_type = 4").count())


def test_gap_counts(A):
    gaps = repurchase.repurchase_gaps(A)
    assert gaps.where("gap_days < 1").count() == 0
    expect = total(repurchase.pay_days_by_user(A), F.col("pay_days") - 1)
    assert gaps.count() == expect
    cum = repurchase.repurchase_gap_cumulative(A).orderBy(F.desc("gap_days")).first()
    assert cum["cum_share"] == pytest.approx(1.0)


def test_gap_list_lengths(A):
    # One entry per purchase after the first, per user.
    lists = repurchase.repurchase_gap_lists(A)
    n = lists.select(
        F.when(F.col("gaps") == "", 0).otherwise(F.size(F.split("gaps", ","))).alias("k"), "user_id"
    )
    buys = value.buy_count_by_user(A)
    bad = n.join(buys, "user_id").where(F.col("k") != F.col("buy_count") - 1)
    assert bad.count() == 0


def test_sql_forms_agree(A):
    pairs = [
        (value.arpu_by_date(A), sql_forms.arpu_by_date_sql(A)),
        (value.paying_ratio_by_date(A), sql_forms.paying_ratio_by_date_sql(A)),
        (repurchase.repurchase_mean_by_user(A), sql_forms.repurchase_mean_by_user_sql(A)),
    ]
    for a, b in pairs:
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_mean_matches_window_form(A):
    # Telescoped aggregate equals the direct per-(user, item) LEAD definition.
    from pyspark.sql import Window

    buys = A.where("behavior_type = 4")
    w = Window.partitionBy("user_id", "item_id").orderBy("date")
    diffs = buys.select("user_id", F.datediff(F.lead("date").over(w), "date").alias("d")).where("d IS NOT NULL")
    direct = diffs.groupBy("user_id").agg(F.avg("d").alias("avg_days"))
    fast = repurchase.repurchase_mean_by_user(A).select("user_id", "avg_days")
    a = {r[0]: r[1] for r in direct.collect()}
    b = {r[0]: r[1] for r in fast.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_gap_runs_rebuild_gap_lists(A):
    # Day by day: the gap (if any) then `repeats` zeros gives the O-31 string.
    from pyspark.sql import Window

    runs = repurchase.repurchase_gap_runs(A)
    zeros = F.array_join(F.array_repeat(F.lit("0"), F.col("repeats").cast("int")), ",")
    piece = F.nullif(F.concat_ws(",", F.col("gap_days").cast("string"), F.nullif(zeros, F.lit(""))), F.lit(""))
    rebuilt = runs.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", piece.alias("p")))),
                                 lambda x: x["p"]), ",").alias("gaps"))
    a = {r[0]: r[1] for r in rebuilt.collect()}
    b = {r[0]: r[1] for r in repurchase.repurchase_gap_lists(A).collect()}
    assert a == b


def test_registered_view(spark, A):
    name = sql_forms.register(A, "actions_view_test")
    n = spark.sql(f"SELECT count(*) FROM {name}").first()[0]
    assert n == A.count()


def test_item_intervals_give_the_mean(A):
    # Sum of intervals (days_to_next + 0-day repeats) over count equals O-32.
    iv = repurchase.repurchase_item_intervals(A)
    per_user = iv.groupBy("user_id").agg(
        F.sum(F.coalesce("days_to_next", F.lit(0))).alias("t"),
        F.sum(F.col("repeats") + F.when(F.col("next_date").isNotNull(), 1).otherwise(0)).alias("n"),
    ).where("n > 0")
    a = {r[0]: r[1] / r[2] for r in per_user.collect()}
    b = {r[0]: r[1] for r in repurchase.repurchase_mean_by_user(A).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])
