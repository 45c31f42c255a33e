"""The whole-report job on the hand-made log: ingest once, write, read back."""

import json
import os

from shopflow.plans import report
from test_fixture_log import BAD, GOOD, HEADER, write


def read_json_dir(path):
    rows = []
    for f in sorted(os.listdir(path)):
        if f.endswith(".json"):
            with open(os.path.join(path, f)) as fh:
                rows += [json.loads(x) for x in fh if x.strip()]
    return rows


def test_report_end_to_end(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, HEADER, *BAD])
    out = os.path.join(scratch, "out")
    good, rejects = report.ingest_text(spark, src, os.path.join(out, "actions"), layout=7)
    assert good.count() == 12
    parts = sorted(p for p in os.listdir(os.path.join(out, "actions")) if p.startswith("accepted="))
    assert parts == ["accepted=false", "accepted=true"]
    names = report.run(spark, good, out, day="2014-12-12", rejects=rejects)
    assert len(names) == len(report.METRICS) + 1 - len(report.ON_REQUEST)
    pvuv = sorted((r["date"], r["pv"], r["uv"]) for r in read_json_dir(os.path.join(out, "pv_uv_by_date")))
    assert pvuv[1] == ("2014-12-12", 6, 2)
    rej = sorted((r["reason"], r["n"]) for r in read_json_dir(os.path.join(out, "rejected_lines")))
    assert rej == [("behavior_type", 2), ("field_count", 2)]
    arpu = {r["date"]: r["arpu"] for r in read_json_dir(os.path.join(out, "arpu_by_date"))}
    assert arpu["2014-12-13"] == 0.0
    report.run(spark, good, out, only=["repurchase_gap_lists"])  # a string per user: only on request
    lists = {r["user_id"]: r["gaps"] for r in read_json_dir(os.path.join(out, "repurchase_gap_lists"))}
    assert lists == {10: "0,3,2", 11: ""}
    # Reduced results are one file each.
    files = [f for f in os.listdir(os.path.join(out, "pv_uv_by_hour")) if f.endswith(".json")]
    assert len(files) == 1


def test_only_rejects_keep_their_line_and_no_date(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, *BAD, "1,2,9,4,2014-12-10 18,1999-01-01,18"])
    stage = os.path.join(scratch, "actions")
    report.ingest_text(spark, src, stage, layout=7)
    table = spark.read.parquet(stage)
    assert table.where("accepted AND line IS NOT NULL").count() == 0
    assert table.where("NOT accepted AND (line IS NULL OR date IS NOT NULL)").count() == 0
    assert len([p for p in os.listdir(os.path.join(stage, "accepted=false")) if p.startswith("date=")]) == 1


def test_reduced_results_are_written_in_order(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD])
    good, _ = report.ingest_text(spark, src, os.path.join(scratch, "actions"), layout=7)
    out = os.path.join(scratch, "out")
    report.run(spark, good, out, day="2014-12-12", gaps_by_frequency=True)
    for name, keys in (("pv_uv_by_date", ["date"]), ("pv_uv_by_hour", ["hour"]), ("pv_by_behavior_hour", ["behavior_type", "hour"]),
                       ("arpu_by_date", ["date"]), ("repurchase_gap_cumulative", ["gap_days"])):
        rows = [tuple(r[k] for k in keys) for r in read_json_dir(os.path.join(out, name))]
        assert rows == sorted(rows) and len(rows) > 1, name
    counts = [r["n"] for r in read_json_dir(os.path.join(out, "repurchase_gap_histogram"))]
    assert counts == sorted(counts, reverse=True)


def test_staged_tables_are_deleted(spark, scratch):
    from shopflow.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {p for p in os.listdir(folder) if p.startswith(("actions-", "hourly-"))}
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, *BAD])
    report.main(["--input", src, "--layout", "7", "--out", os.path.join(scratch, "out"), "--only", "pv_uv_by_date,dataset_profile"])
    assert {p for p in os.listdir(folder) if p.startswith(("actions-", "hourly-"))} == before


def test_report_survives_a_user_with_billions_of_purchases(spark, scratch):
    import datetime as dt

    day = dt.date(2014, 12, 10)
    rows = [(1, 7, 4, 1, dt.datetime(2014, 12, 10, 8), day, 8, 8_000_000_000), (2, 7, 1, 1, dt.datetime(2014, 12, 10, 8), day, 8, 1)]
    actions = spark.createDataFrame(rows, "user_id long, item_id long, behavior_type int, item_category long, time timestamp_ntz, date date, hour int, n_actions long")
    out = os.path.join(scratch, "out")
    report.run(spark, actions, out)
    runs = read_json_dir(os.path.join(out, "repurchase_gap_runs"))
    assert [(r["user_id"], r["repeats"]) for r in runs] == [(1, 7_999_999_999)]


def test_report_cli_on_events(spark, scratch):
    out = os.path.join(scratch, "ev")
    report.main(["--input", "/root/testdata/sf0.001/events.parquet", "--format", "events",
                 "--out", out, "--day", "2024-01-12"])
    rows = read_json_dir(os.path.join(out, "dataset_profile"))
    assert rows[0]["rows"] == 1000


def test_report_text_and_tsv_sinks(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD])
    good, rejects = report.ingest_text(spark, src, layout=7)  # staged under the checkpoint folder
    out_t = os.path.join(scratch, "txt")
    report.run(spark, good, out_t, rejects=rejects, sink="text")
    lines = [r[0] for r in spark.read.text(os.path.join(out_t, "pv_uv_by_date")).collect()]
    assert "date: 2014-12-12, pv: 6, uv: 2" in lines
    out_v = os.path.join(scratch, "tsv")
    report.run(spark, good, out_v, sink="tsv")
    rows = [r[0].split("\t") for r in spark.read.text(os.path.join(out_v, "pv_uv_by_date")).collect()]
    assert ["2014-12-12", "6", "2"] in rows


def test_ingest_with_rebalance(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, *BAD])
    good, rejects = report.ingest_text(spark, src, os.path.join(scratch, "rb"), layout=7, rebalance=True)
    assert os.path.isdir(os.path.join(scratch, "rb", "accepted=true"))
    assert good.count() == 12 and rejects.count() == 4


def test_report_same_with_and_without_hourly_counts(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, HEADER, *BAD])
    good, rejects = report.ingest_text(spark, src, layout=7)
    a, b = os.path.join(scratch, "pre"), os.path.join(scratch, "raw")
    names = report.run(spark, good, a, day="2014-12-12", rejects=rejects)
    assert names == report.run(spark, good, b, day="2014-12-12", rejects=rejects, preaggregate=False)
    for n in names:
        x, y = spark.read.json(os.path.join(a, n)), spark.read.json(os.path.join(b, n))
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, n


def test_report_only_some_metrics(spark, scratch):
    import pytest

    out = os.path.join(scratch, "some")
    report.main(["--input", "/root/testdata/sf0.001/events.parquet", "--format", "events",
                 "--out", out, "--only", "pv_uv_by_date,repurchase_mean_by_user"])
    assert sorted(p for p in os.listdir(out) if not p.startswith(".")) == ["pv_uv_by_date", "repurchase_mean_by_user"]
    with pytest.raises(ValueError):
        report.run(spark, None, out, only=["no_such_metric"])


def test_report_cli_on_text_log(spark, scratch):
    src = write(os.path.join(scratch, "log.csv"), [HEADER, *GOOD, *BAD])
    out = os.path.join(scratch, "cli")
    report.main(["--input", src, "--layout", "7", "--out", out, "--day", "2014-12-12",
                 "--spread", "2", "--rebalance", "--sink", "tsv",
                 "--only", "pv_uv_by_hour_on_day,rejected_lines",
                 "--stage-dir", os.path.join(scratch, "stage")])
    rows = sorted(r[0].split("\t") for r in spark.read.text(os.path.join(out, "pv_uv_by_hour_on_day")).collect())
    assert rows == [["20", "3", "1"], ["21", "2", "1"], ["7", "1", "1"]]
    rej = sorted(r[0] for r in spark.read.text(os.path.join(out, "rejected_lines")).collect())
    assert rej == ["behavior_type\t2", "field_count\t2"]
