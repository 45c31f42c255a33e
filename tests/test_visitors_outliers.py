"""Visitors of any days from bitmaps, outlying groups, quality per file."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paths import SF_CHECK
from shopflow.operators import outliers, profile, traffic, visitors
from shopflow.plans.catalog import actions
from shopflow.sources.text_log import read_lines
from test_fixture_log import BAD, GOOD, HEADER, write
from test_ordered_funnel import frame


def test_any_range_from_the_written_table(spark, scratch):
    A = actions(spark, SF_CHECK)
    visitors.visitor_bitmaps(A).write.partitionBy("date").parquet(scratch + "/bitmaps")
    table = spark.read.parquet(scratch + "/bitmaps")
    days = sorted(r["date"] for r in A.select("date").distinct().collect())
    rng = random.Random(1)
    for _ in range(5):
        a, b = sorted(rng.sample(days, 2))
        want = A.where(F.col("date").between(a, b)).agg(F.count_distinct("user_id")).first()[0]
        assert visitors.uv_between(table, a, b).first()["uv"] == want
    plan = visitors.uv_between(table, days[0], days[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan  # other days are not read
    assert visitors.uv_between(table, "1999-01-01", "1999-01-02").first()["uv"] == 0


def test_ids_of_any_size_are_exact(spark, scratch):
    ids = [0, 1, -1, 32768, 32769, -32767, -32768, -32769, 2**62, -(2**62), 10**12, 10**12 + 1]
    log = [(u, 1, h) for h in (0, 30) for u in ids] + [(None, 1, 1)]
    A = frame(spark, log)
    assert visitors.count_visitors(visitors.visitor_bitmaps(A)).first()["uv"] == len(ids)
    numbers = scratch + "/users"
    visitors.number_users(A.repartition(3)).write.parquet(numbers)
    known = spark.read.parquet(numbers)
    more = frame(spark, [(u, 1, 60) for u in [5, 6, 7, 1, None]])
    visitors.number_users(more, known).write.parquet(scratch + "/more")
    both = known.unionByName(spark.read.parquet(scratch + "/more"))
    assert both.select("user_id").distinct().count() == both.select("number").distinct().count() == both.count() == len(ids) + 3
    maps = visitors.visitor_bitmaps(A.unionByName(more), numbers=both)
    assert visitors.count_visitors(maps).first()["uv"] == len(ids) + 3
    assert visitors.count_visitors(visitors.visitor_bitmaps(A.limit(0))).first()["uv"] == 0


def test_rolling_windows_over_days_without_visitors(spark):
    log = [(1, 1, 0), (2, 1, 24 * 3), (1, 1, 24 * 3), (3, 1, 24 * 9), (None, 1, 24 * 5)]
    got = visitors.uv_rolling(visitors.visitor_bitmaps(frame(spark, log)), 4).collect()
    assert sorted((r["date"].day, r["uv"]) for r in got) == [(1, 1), (4, 2), (10, 1)]


def test_crawler_is_cut_and_others_stay(spark):
    log = [(u, 1, h) for u in range(200) for h in (1, 2)] + [(999, 1, 5)] * 500 + [(None, 1, 5)] * 900
    A = frame(spark, log).repartition(5)
    cuts = {r["rule"]: tuple(r)[1:] for r in outliers.activity_cuts(A).collect()}
    assert cuts["q99"] == (1.0, 1, 500) and cuts["iqr"] == (1.0, 1, 500)
    assert cuts["mean_3sd"][1:] == (1, 500)
    assert [tuple(r)[:1] + tuple(r)[3:] for r in outliers.outlier_groups(A, "iqr").collect()] == [(999, 500, 1.0)]
    kept = outliers.without_outliers(A, "iqr")
    assert kept.count() == 400 + 900 and kept.where("user_id = 999").count() == 0
    assert [tuple(r) for r in outliers.activity_cuts(A.limit(0)).collect()] == [(r, None, 0, 0) for r in ("q99", "q999", "iqr", "mean_3sd")]


def test_quantiles_match_a_plain_list(spark):
    rng = random.Random(4)
    log = [(u, 1, 1) for u in range(300) for _ in range(rng.choice([1, 1, 2, 3, 9, 40]))]
    counts = sorted({u: sum(x[0] == u for x in log) for u in range(300)}.values())
    at = lambda q: counts[-(-q * len(counts) // 10_000) - 1]
    cuts = {r["rule"]: r["cut"] for r in outliers.activity_cuts(frame(spark, log)).collect()}
    assert cuts["q99"] == at(9900) and cuts["q999"] == at(9990)
    assert cuts["iqr"] == at(7500) + 1.5 * (at(7500) - at(2500))


@pytest.mark.parametrize("spread", [None, 3])
def test_a_corrupt_file_is_named(spark, scratch, spread):
    for i in range(3):
        write(os.path.join(scratch, f"good{i}.csv"), [HEADER, *GOOD])
    write(os.path.join(scratch, "bad.csv"), [HEADER, *BAD, GOOD[0], "1,2", "3,4", "5"])
    write(os.path.join(scratch, "empty.csv"), [HEADER])
    lines = read_lines(spark, scratch, spread, with_file=True)
    found = {os.path.basename(r["file"]): r for r in profile.file_quality(lines).collect()}
    assert set(found) == {"good0.csv", "good1.csv", "good2.csv", "bad.csv"}  # a file of headers has no lines
    bad = found["bad.csv"]
    assert (bad["n_rejected"], bad["main_reason"]) == (len(BAD) + 3, "field_count") and bad["reject_share"] == (len(BAD) + 3) / (len(BAD) + 4)
    assert all(r["n_rejected"] == 0 and r["main_reason"] is None and r["n_lines"] == len(GOOD) for f, r in found.items() if f != "bad.csv")
    whole = {r["column_name"]: (r["n_missing"], r["n_rejected"]) for r in profile.log_profile(lines.select("value")).collect()}
    per_file = profile.log_profile(lines, by=("file",)).groupBy("column_name").agg(F.sum("n_missing"), F.sum("n_rejected")).collect()
    assert {r[0]: (r[1], r[2]) for r in per_file} == whole


def test_pv_without_outliers_is_at_most_pv(spark):
    A = actions(spark, SF_CHECK)
    kept = outliers.without_outliers(A, "q99", ("user_id", "date"))
    both = traffic.pv_by_date(A).withColumnRenamed("pv", "all").join(traffic.pv_by_date(kept), "date")
    assert both.where("pv > all").count() == 0 and kept.count() < A.count()
