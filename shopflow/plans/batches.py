"""The events as they would arrive: day by day in batches and in files, some of them late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.plans.messy_log import messy_lines
from shopflow.plans.store import ActionStore
from shopflow.schema import ACTION_COLUMNS, day_literal
from shopflow.session import ensure_checkpoint_dir
from shopflow.sources.text_log import read_lines


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, actions: DataFrame, day: str) -> ActionStore:
    """A new store that has taken all actions in three batches.

    The first has the days up to ``day``, the second those after it, the
    third what was late: every tenth event, of any day.  One pass over the
    actions writes the files that each batch comes in.
    """
    store = ActionStore(spark, _folder(spark, "store"))
    late, early = F.col("event_id") % 10 == 0, F.col("date") <= day_literal(day)
    batch = F.when(late, "3").when(~late & early, "1").when(~late & ~early, "2")
    rows = actions.select(*ACTION_COLUMNS, batch.alias("batch")).where("batch IS NOT NULL")
    path = _folder(spark, "arrived")
    rows.write.partitionBy("batch").parquet(path)
    arrived = spark.read.schema(rows.schema).parquet(path)
    for name in ("1", "2", "3"):
        store.apply(name, arrived.where(F.col("batch") == name).drop("batch"))
    return store


def files_by_day(spark: SparkSession, actions: DataFrame) -> DataFrame:
    """The messy log written as text, a folder per day, and read again: ``value, file`` with the day's folder as ``file``."""
    path = _folder(spark, "log")
    messy_lines(actions, keep=("date",)).write.partitionBy("date").text(path)
    lines = read_lines(spark, path, with_file=True)
    return lines.select("value", F.regexp_extract("file", "/date=([^/]*)/", 1).alias("file"))
