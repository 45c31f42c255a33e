"""Helpers shared by the operators: table reading, staging, word patterns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.session import ensure_checkpoint_dir

#: A word is a maximal run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def python_path(spark: SparkSession) -> None:
    """Puts this package's folder on the Python workers' path.

    Enough where executors see the same folder, as local ones do; elsewhere
    the package is installed on the cluster or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Cuts the lineage: what follows reads the written rows, also after an
    executor is lost.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text) -> "F.Column":
    """The words of a text column as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text) -> "F.Column":
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but the ``used`` ones under names that clash with nothing, and the way back.

    The second value takes a frame that still has these columns, and the names
    of columns that were added: it returns the columns of ``docs`` and the
    added ones.  A column of ``docs`` named like an added one is replaced.
    """
    names = docs.columns
    hidden = [c if c in used else f"__{i}" for i, c in enumerate(names)]

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*[F.col(f"`{h}`").alias(c) for c, h in zip(names, hidden, strict=True) if c not in added], *added)

    return docs.toDF(*hidden), back
