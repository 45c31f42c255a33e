"""Adapters: the props fast path equals the JSON parser on any input."""

from pyspark.sql import functions as F

from shopflow.sources.events import props_k


def test_props_k_matches_json_parser(spark):
    samples = ['{"k": 69}', '{"k":5}', '{"k": 0}', '{"k": -3}', '{"k": 007}', '{ "k" : 5 }',
               '{"k": 5, "x": 1}', '{"x": {"k": 3}}', '{"k": "7"}', '{"k": 1.5}', 'null', '',
               'not json', '{"k": 12345678901}', None]
    df = spark.createDataFrame([(s,) for s in samples], "props string")
    got = df.select(props_k(F.col("props")).alias("a"), F.get_json_object("props", "$.k").alias("b"))
    rows = got.collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_malformed_item_is_null_not_a_failure(spark):
    import datetime as dt

    from shopflow.sources.events import from_events

    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 5), 7, "view", 1.0, '{"k": 7.5}'),
         (2, dt.datetime(2024, 1, 1, 6), 8, "view", 1.0, '{"k": 12}')],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    )
    assert [(r.item_id, r.item_category) for r in from_events(df).orderBy("event_id").collect()] == [(None, None), (12, 1)]
